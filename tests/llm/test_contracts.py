"""The queries themselves, with production parameters, against brute force over the whole smallest tables; hard inputs of the operators."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from cohortlens.llm import exact, jaccard, licenses, packing, queries, suffixes, toxicity
from test_corpus import brute_bytes, brute_links, brute_windows, check_pieces, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name, key="doc_id"):
    df = queries.QUERIES[name](spark, SF)
    return dict(df.dtypes), {r[key]: r for r in df.collect()}


def test_op1(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kinds, got = rows(spark, "op1_sentencepiece")
    assert kinds == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} and set(got) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode()))


def test_op2(spark, texts):
    kinds, got = rows(spark, "op2_exact_dedup")
    assert kinds == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    same = collections.defaultdict(list)
    for i, t in texts.items():
        same[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for norm, ids in same.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, sha(norm.encode())) for i in ids)


def test_op3(spark, texts):
    kinds, got = rows(spark, "op3_toxicity")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and set(got) == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def test_op4(spark, texts):
    kinds, got = rows(spark, "op4_suffix_dedup")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: (*w[:3], sha(w[3])) for i, w in brute_bytes(texts, 400).items()}


def test_op5(spark, texts):
    kinds, got = rows(spark, "op5_media")
    want = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint",
        "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    assert kinds == want and set(got) == set(texts)
    stored = collections.defaultdict(set)
    for i, t in texts.items():
        data = (t or "").encode()
        pay = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pay), sha(pay), zlib.crc32(pay[-16:]))
        assert r["media_bytes"] > 0 and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["feature"]
        stored[pay].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in stored.values()) and len({next(iter(v))[1] for v in stored.values()}) == len(stored)


def test_op6(spark, texts):
    kinds, got = rows(spark, "op6_jaccard_join")
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), c) for i, (_, c) in brute_links(texts).items()}
    for i, r in got.items():
        assert r["n_links"] == sum(j != i and len(sets[i] & s) * 100 >= 75 * len(sets[i] | s) > 0 for j, s in sets.items())


def test_op7(spark, texts):
    kinds, got = rows(spark, "op7_licenses")
    want = {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    assert kinds == want and set(got) == set(texts)
    phrases = [(p.split(), label) for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))]
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for k in range(len(w)) for p, label in phrases if w[k : k + len(p)] == p]
        r, own = got[i], sorted({label for _, label in at})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at),
            min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(own))
        labels = r["labels"].split(",") if r["labels"] else []
        assert set(own) <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1


def test_op8(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    kinds, got = rows(spark, "op8_warc", "page_id")
    assert kinds == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"} and set(got) == set(pages)
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i] or "", i)
    for i, h in pages.items():
        data, owner = (h or "").encode(), first[h or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if owner == i else "revisit", None if owner == i else owner)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want


def test_op9(spark, texts):
    df = queries.QUERIES["op9_packing"](spark, SF)
    assert set(df.dtypes) == {(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    got = df.collect()
    check_pieces(got, texts)
    assert sum(r["length"] for r in got) > 0.9 * 1024 * len({r["sequence_id"] for r in got}) - 1024 * 16


def test_op10(spark, texts):
    kinds, got = rows(spark, "op10_substring_dedup")
    assert kinds == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: (n, gone, sha(kept.encode())) for i, (n, gone, kept) in brute_windows(texts).items()}


def test_toxicity_labels_without_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "text 3")] * 5 + [(None, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(i, i % 2) for i in range(1000, 1200)], "doc_id long, toxic int")
    for labels in (gone, gone.limit(0), gone.unionByName(spark.createDataFrame([(2, 0), (3, None)], gone.schema))):
        got = toxicity.classify(docs, docs, labels).collect()
        assert len(got) == 26 and {r["predicted"] for r in got} == {0}
    some = gone.unionByName(spark.createDataFrame([(i, int(i < 8)) for i in range(20)], gone.schema))
    sample, n = toxicity.training_rows(docs, some)
    assert sample.count() == sum(n.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "a" * 2_000_000, "^" * 2_000_000, "x" + " " * 5000 + "y" + " " * 4999, "\n \t" * 400_000])
def test_packing_long_runs(text):
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_licenses_in_chains(spark):
    notice = licenses.NOTICES["mit-notice"]
    phrase = "free of charge to any person "
    docs = spark.createDataFrame([(1, phrase * 60 + notice), (2, phrase * 400), (3, notice + " " + phrase * 60),
        (4, " ".join(w for k, w in enumerate(notice.split()) if k % 9))], "doc_id long, text string")
    got = {r["id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["labels"] == got[3]["labels"] == got[4]["labels"] == "mit-notice" and got[1]["score"] == got[3]["score"] == 1
    assert got[2]["labels"] == "" and got[2]["score"] < 0.2


def test_licenses_rows_stay_narrow(spark):
    """What is exploded holds a gram's own words, never the text's: the plan grows with a text's length, not with its square."""
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    plan = licenses.hits(docs, licenses.templates(spark, licenses.PHRASES, {}), "doc_id", "text")._jdf.queryExecution().optimizedPlan()
    stack, found = [plan], 0
    while stack:
        node = stack.pop()
        if node.nodeName() == "Generate":
            found += 1
            assert not any(a.dataType().simpleString() in ("string", "array<string>") for a in map(node.output().apply, range(node.output().size())))
        stack += [node.children().apply(k) for k in range(node.children().size())]
    assert found == 1


def test_stages_with_clashing_names(spark):
    """Columns named like the stages' own, nulls, repeated rows, empty tables, and no n_chars."""
    base = " ".join(f"w{i}" for i in range(150))
    schema = "doc_id long, text string, key long, th long, spans string, row string, own int, place int, gone int, stay int, _row int, k int, t int"
    data = [(i, t, *(k for k in range(11))) for i, t in ((1, base), (2, base + " x"), (3, "p " + base + " q r s t u v w x y z" * 9), (4, None), (4, None), (5, ""), (None, "one two three"))]
    docs = spark.createDataFrame([(*r[:4], str(r[4]), str(r[5]), *r[6:]) for r in data], schema)
    for stage in (exact.kept_rows, jaccard.representatives, suffixes.cleaned):
        out = stage(docs)
        assert out.columns == docs.columns and stage(docs.limit(0)).count() == 0
        got = out.collect()
        assert all(r["own"] == 4 and r["t"] == 10 for r in got) and len(got) == {"kept_rows": 5, "representatives": 4, "cleaned": 7}[stage.__name__]
    cut = {r["doc_id"]: r["text"] for r in suffixes.cleaned(docs).collect()}
    assert cut[1] == "" and cut[2] == "x" and cut[4] is None and cut[5] == "" and cut[3].startswith("p ")


def test_pipeline_of_empty_table(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_extra_columns(spark, tmp_path):
    """run() on whole rows that repeat, nulls in any column and columns that clash, against the stages by brute force."""
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randrange(99)) for _ in range(140)) for _ in range(12)]
    data = [(i, t, "en", "s", len(t), i, "x") for i, t in enumerate(base + [base[0] + " end", base[1].replace(" ", "  "), " ".join(f"lead{k}" for k in range(90)) + base[2] + " tail" * 200])]
    data += [data[0], (None, None, None, None, None, None, None), (50, "", None, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key long, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t, *_ in data if i not in (12, 50) and i is not None}  # 12 and 13 repeat 0 and 1, an empty text repeats the null one
    first = 13  # the longer of the equal texts 1 and 13 stays
    kept.pop(1)
    kept[first] = base[1].replace(" ", "  ")
    want = {i: w[3].decode(errors="ignore") for i, w in brute_bytes(kept, 400).items()} | {None: None}
    check_pieces(got, want)
    assert json.dumps(sorted({r["doc_id"] for r in got if r["doc_id"] is not None})) == json.dumps(sorted(kept))
    assert np.all(np.array([r["length"] for r in got]) > 0)
