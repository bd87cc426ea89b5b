"""The corpus operators against brute force, on texts made to be awkward."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import exact, jaccard, licenses, media, packing, pieces, substrings, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, n long, key string, size string"  # the last three clash with names inside


def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["the", "The", "é", "日本", "x.", "a\tb"]
    base = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 5, 24, 60, 90, 150)]
    out = {}
    for i in range(90):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, max(1, len(w) // 15))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out[i] = rng.choice([" ", "  ", "\n"]).join(w) + rng.choice(["", " " + rng.choice(base)])
    out |= {200: None, 201: "", 202: " \n\t ", 203: "a" * 1500, 204: "ab " * 400, 205: " ".join(str(i) for i in range(20000)), 206: "word",
        207: "word", 208: "x\x00y \x01\x02 <s> ▁▁ z", 209: "😀" * 500}
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, None, "s") for i, t in TEXTS.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null identifiers, one identifier with two texts."""
    return spark.createDataFrame([(1, "p q r s t u", None, None, None, None)] * 2 + [(None, "p q r s t u", None, None, None, None),
        (None, None, None, None, None, None), (2, "one", None, None, None, None), (2, "two", None, None, None, None)], SCHEMA).coalesce(1)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_sentencepiece(docs, nothing, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        want = collections.Counter((r["doc_id"], tuple(sp.encode(r["text"] or "")), sp.decode(sp.encode(r["text"] or ""))) for r in df.collect())
        got = collections.Counter((r["id"], tuple(np.frombuffer(r["ids"], np.uint16).tolist()), r["decoded"]) for r in pieces.encode(df, path).collect())
        assert got == want
    assert pieces.encode(nothing, path).count() == 0
    assert pieces.crossing_pieces(path) == []


def test_exact_groups(spark, docs, nothing, odd):
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["sha"].hex()) for r in exact.groups(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t in TEXTS.items():
        groups["".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")].append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            assert got[i] == (keep, len(ids), i == keep, sha(norm.encode()))
    assert exact.groups(nothing).count() == 0
    r = exact.groups(odd).collect()
    assert sorted(x["group_size"] for x in r) == [1, 1, 1, 3, 3, 3] and sum(x["kept"] for x in r) == 4
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text")).repartition(9)
    r = exact.groups(many).filter("group_size > 1").collect()  # one group over several ranges
    assert len(r) == 1000 and {x["keep_id"] for x in r} == {0} and sum(x["kept"] for x in r) == 1


def test_toxicity(spark, nothing):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(60)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["zounds", "varlet", "knave"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(600, None), (601, ""), (None, "varlet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(600, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    got = {r["id"]: r for r in toxicity.classify(docs, docs, lab).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    kept = toxicity.accepted(docs, toxicity.fit(*toxicity.training_rows(docs, lab)))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    none = toxicity.classify(docs, docs, lab.filter("toxic = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.classify(nothing, docs, lab).count() == 0


def test_media(docs, nothing):
    for t in TEXTS.values():
        p = media.padded(t)
        assert media.read_back(media.store(p)) == p and len(p) % 192 == 0 and p
    html = '<p>One <b>two</b></p><script>no</script><figure><img src="media:abc" alt="alt"><figcaption>A &amp; b</figcaption></figure>tail<img src="media:zz" alt="only alt"><img src="http://x">'
    assert media.parse(html) == [["text", "One two", None], ["media", "A & b", "abc"], ["text", "tail", None], ["media", "only alt", "zz"]]
    assert media.parse(None) == media.parse("") == []
    store = media.media_table(docs)
    assert store.count() == len({media.padded(t) for t in TEXTS.values()})
    spark = docs.sparkSession
    digest = sha(media.padded(TEXTS[203]))
    pages = spark.createDataFrame([(1, f'a<img src="media:{digest}" alt="x">b<img src="media:gone">'), (2, None)], "page_id long, html string")
    row = media.assemble(media.resolve(media.sequences(pages), store)).collect()
    assert len(row) == 1 and [(x["position"], x["kind"], x["text"]) for x in row[0]["items"]] == [(0, "text", "a"), (1, "media", "x"), (2, "text", "b"), (3, "media", None)]
    assert media.read_back(row[0]["items"][1]["medium"]).rstrip(b" ") == b"a" * 1500 and row[0]["items"][3]["medium"] is None
    assert media.media_table(nothing).count() == 0


def brute_windows(docs, w=20):
    seen, out = set(), {}
    for i in sorted(docs):
        words = (docs[i] or "").encode().split()
        hit = [False] * len(words)
        for k in range(len(words) - w + 1):
            t = tuple(words[k : k + w])
            if t in seen:
                hit[k : k + w] = [True] * w
            seen.add(t)
        out[i] = (len(words), sum(hit), b" ".join(x for x, h in zip(words, hit, strict=True) if not h).decode())
    return out


@pytest.mark.parametrize("most", [50_000, 1])
def test_substrings(docs, nothing, odd, most):
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove(docs, most_in_class=most).collect()}
    assert got == brute_windows(TEXTS)
    assert substrings.remove(nothing).count() == 0
    small = sorted((str(r["id"]), r["n_words"], r["n_removed"]) for r in substrings.remove(odd, window=3, gram=2).collect())
    assert small == [("1", 6, 6), ("1", 6, 6), ("2", 1, 0), ("2", 1, 0), ("None", 0, 0), ("None", 6, 0)]


def brute_bytes(docs, w):
    data = {i: (t or "").encode() for i, t in docs.items()}
    n = collections.Counter(b[k : k + w] for b in data.values() for k in range(len(b) - w + 1))
    out = {}
    for i, b in data.items():
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if n[b[k : k + w]] > 1:
                hit[k : k + w] = True
        spans = int(np.sum(hit & ~np.concatenate([[False], hit[:-1]])))
        out[i] = (len(b), int(hit.sum()), spans, bytes(x for x, h in zip(b, hit, strict=True) if not h))
    return out


@pytest.mark.parametrize(("length", "gram", "most"), [(400, 100, 50_000), (60, 16, 50_000), (60, 16, 1)])
def test_suffixes(docs, nothing, odd, length, gram, most):
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove(docs, length, gram, most_in_class=most).collect()}
    assert got == brute_bytes(TEXTS, length)
    assert suffixes.remove(nothing).count() == 0
    assert sorted(r["n_removed"] for r in suffixes.remove(odd, 5, 2).collect()) == [0, 0, 0, 11, 11, 11]


def test_suffix_columns():
    """Every column's order and common prefixes, against sorting the suffixes themselves."""
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(40)]
    group = sorted(rng.randrange(4) for _ in strings)
    symbols = np.zeros((40, 12), np.uint16)
    for i, s in enumerate(strings):
        symbols[i, : len(s)] = np.frombuffer(s.encode(), np.uint8) + 1
    for c, order, common in suffixes.columns(np.array(group), symbols):
        suffix = [(group[i], strings[i][c:]) for i in order]
        assert suffix == sorted(suffix)
        for k in range(1, 40):
            a, b = suffix[k - 1], suffix[k]
            want = next((j for j, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0
            assert common[k] == want


def test_cleaned_texts(docs):
    out = {r["doc_id"]: r for r in suffixes.cleaned(docs.withColumn("n_chars", F.length("text").cast("long")), 60, 16).collect()}
    want = brute_bytes(TEXTS, 60)
    for i, t in TEXTS.items():
        assert (out[i]["text"] or "") == want[i][3].decode(errors="ignore")
        if want[i][1]:
            assert out[i]["n_chars"] == len(out[i]["text"])


def brute_links(docs):
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in docs.items()}
    top = {i: i for i in docs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_jaccard_join(docs, nothing, odd):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == brute_links(TEXTS)
    kept = {r["doc_id"] for r in jaccard.representatives(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}
    assert jaccard.join(nothing).count() == 0
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in jaccard.join(odd).collect()) == [(-1, -1), (-1, -1), (1, -1), (1, -1), (2, 2), (2, 2)]


def test_jaccard_join_in_parts(docs, odd, monkeypatch):
    """Every member dealt in several parts."""
    monkeypatch.setattr(jaccard, "FREQUENT", 0.01)
    monkeypatch.setattr(jaccard, "PART_ROWS", 0.3)
    assert (jaccard.parts_of(np.array([0, 1, 5]), 0.02, 0.3) == [1, 1, 5]).all()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()} == brute_links(TEXTS)
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in jaccard.join(odd).collect()) == [(-1, -1), (-1, -1), (1, -1), (1, -1), (2, 2), (2, 2)]


def test_shingles_and_bounds():
    assert len(jaccard.shingles("A b c")) == 1 and jaccard.shingles("A b c").tolist() == jaccard.shingles("a  B\tC ").tolist()
    assert len(jaccard.shingles(None)) == len(jaccard.shingles(" \n")) == 0 and len(jaccard.shingles("a b c d e f")) == 2
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(1, len(a) + 1), False), rng.integers(0, 2**63, rng.integers(1, 150), np.uint64)]))
        if jaccard.links(len(np.intersect1d(a, b)), len(a), len(b)):
            assert jaccard.may_link(len(a), jaccard.signature(a), len(b), jaccard.signature(b))


def test_licenses(spark, docs, nothing, odd):
    rows = {1: "Under THE MIT-License; under the mit license", 2: "apache license version 2.0 and Apache License, Version 2", 3: "cc by nc cc by nc",
        4: "under the mit licence", 5: None, 6: "", 7: " ".join(list(licenses.NOTICES.values())[0].split()[:40] + ["inserted",
        "words"] + list(licenses.NOTICES.values())[0].split()[40:]), 8: "Über cc\nby/nc"}
    got = {r["id"]: r for r in licenses.scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 4, "mit")
    assert got[2]["n_base"] == 2 and (got[3]["n_base"], got[3]["last_word"], got[3]["base_labels"]) == (2, 3, "cc-by-nc")
    assert got[4]["n_base"] == got[5]["n_base"] == got[6]["n_words"] == 0 and got[5]["first_word"] is None and got[5]["labels"] == "" and got[5]["score"] == 0
    assert "mit-notice" in got[7]["labels"] and 0.6 <= got[7]["score"] <= 1 and got[7]["n_base"] == 0
    assert got[8]["n_words"] == 4 and got[8]["first_word"] == 1
    for r in licenses.scan(docs).collect():
        assert r["n_words"] == len(licenses.template_words(TEXTS[r["id"]] or ""))
    assert licenses.scan(nothing).count() == 0 and licenses.scan(odd).count() == 6


def test_warc(spark):
    rows = [(1, "http://a.b/x", "same"), (2, None, "same"), (2, None, "same"), (None, "http://www.q.org/é\n", None), (5, "http://a.b/x", ""),
        (6, "not a url", "é" * 10), (7, "https://sub.a.b/y?Z=1", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.shared_path(spark, "warc-test")
    blocks, directory = warc.index(warc.write(pages, folder))
    asked = [(warc.url_key(u), warc.NULL_ID if i is None else i) for i, u, _ in rows]
    got = {r["page_id"]: r for r in warc.read(warc.find(blocks, directory, spark.createDataFrame(asked + [("zzz", 4), ("", 99)], "key string, page long")), folder).collect()}
    assert len(got) == 6
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    assert (got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 1) and got[5]["record_type"] == "revisit" and got[None]["record_type"] == "response"
    assert warc.url_key("http://www.a.b.org/P?Q") == "org,b,a)/p?q" and warc.url_key(None) == ""
    empty = warc.write(pages.limit(0), warc.shared_path(spark, "warc-none"))
    assert warc.find(*warc.index(empty), spark.createDataFrame(asked, "key string, page long")).count() == 0


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of, in_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        in_seq[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for v in in_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH


def test_packing(docs, nothing, odd, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_pieces(packing.pack(docs, path).collect(), TEXTS)
    assert packing.pack(nothing, path).count() == 0
    assert packing.pack(odd, path).filter("doc_id = 1").count() == 2
    texts = TEXTS | {300: "<|endoftext|> in a text", 301: "a 　 b \x1cc  d\n\n e"}
    enc = packing.Encoder(path)
    monkeypatch.setattr(packing, "BLOCK", 3000)
    stream, rows = packing._Stream(enc, 0), []
    for i, t in texts.items():
        stream.add(i, t)
        if stream.size >= packing.BLOCK and (b := stream.pack(False)):
            rows += b.to_pylist()
    check_pieces(rows + stream.pack(True).to_pylist(), texts)


def test_cuts_are_the_best():
    rng = random.Random(9)
    for _ in range(40):
        at = [0]
        while len(at) < 9:
            at.append(at[-1] + rng.randint(50, 600))
        pen = [rng.choice([0, 2, 12]) for _ in at]
        best = {0: 0}
        for j in range(1, 9):
            best[j] = min(best[i] + packing.LENGTH - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= packing.LENGTH)
        chosen = [0, *packing.cuts(np.array(at), np.array(pen))]
        cost = sum(packing.LENGTH - (b - a) + pen[at.index(b)] for a, b in zip(chosen, chosen[1:], strict=False))
        assert cost == best[8] and chosen[-1] == at[-1]


def test_queries_and_sql(spark):
    import duckdb

    from cohortlens.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        got = con.execute(sql)
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, sf)
        if name == "packing":
            check_pieces(out.collect(), before)
            break
        path = f"{corpus_pipeline.shared_path(spark, 'stage')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "suffixes":
            want = brute_bytes(before, 400)
            assert {i: t.encode() for i, t in after.items()} == {i: w[3].decode(errors="ignore").encode() for i, w in want.items()}
        elif name == "exact":
            assert len(after) == len({exact.normalised(t) for t in before.values()})
        elif name == "jaccard":
            assert set(after) == {i for i, (_, c) in brute_links(before).items() if c == i}
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_jaccard_counts_all_links(spark, monkeypatch):
    """Groups of three and more near copies, equal sets in several tasks, repeated rows, blocks."""
    rng = random.Random(11)
    base = [[f"{g}w{i}" for i in range(60)] for g in range(3)]
    rows = []
    for i in range(60):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1].upper()), (101, rows[0][1] + " "), (102, rows[3][1]), (102, rows[3][1]), (103, ""), (None, rows[0][1]), (None, rows[1][1])]
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    want = [sum(i != j and len(a) > 0 and len(b) > 0 and bool(jaccard.links(len(a & b), len(a), len(b))) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (1024, 4):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", most)
        assert collections.Counter((r["id"], r["n_links"]) for r in jaccard.join(docs).collect()) == collections.Counter(zip((i for i, _ in rows), want, strict=True))


def test_pipeline_stages_keep_one_row_of_each_group(spark):
    """Repeated rows and null identifiers in the exact, near and substring stages."""
    import corpus_pipeline

    long, other, third = (" ".join(f"{c}{i}" for i in range(120)) for c in "abc")
    near = lambda t, k: t + f" end{k}"
    rows = [(1, long)] * 3 + [(None, "x y")] * 2 + [(None, " x  y ")] * 2 + [(None, near(other, 0)), (5, near(other, 1)), (6, near(other, 2)),
        (None, near(third, 0)), (None, near(third, 1)), (7, near(third, 2)), (8, "one"), (8, "two"), (None, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    exact_rows = stages["exact"](spark, docs, None)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in exact_rows.collect()))) == sorted(map(str, [(1, long), (None, " x  y "), *rows[7:]]))
    path = corpus_pipeline.shared_path(spark, "odd")
    exact_rows.write.parquet(path)
    for some in (spark.read.parquet(path), docs):
        left = stages["jaccard"](spark, some, None)
        texts = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
        assert texts[(1, long)] == 1 and not {5, 6, 7} & {i for i, _ in texts} and {(None, near(other, 0)), (8, "one"), (8, "two"), (None, None)} <= set(texts)
        assert sum(n for (_, t), n in texts.items() if (t or "").startswith("c0")) == 1 and sum(n for (_, t), n in texts.items() if t and t.split() == ["x", "y"]) == 1
        assert left.columns == docs.columns
    done = stages["suffixes"](spark, stages["jaccard"](spark, spark.read.parquet(path), None), None)
    assert [r["text"] for r in done.filter("doc_id = 1").collect()] == [long]


def test_hot_media(spark, monkeypatch):
    """References of a hot digest are resolved by a broadcast, or not, with the same result."""
    texts = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), "id")
    store = media.media_table(texts)
    refs = texts.select("id", F.lit(0).alias("position"), F.lit("media").alias("kind"), F.lit(None).cast("string").alias("text"),
        F.when(F.col("id") % 2 == 0, sha(media.padded("hot"))).otherwise("gone").alias("digest"))
    for most in (32 << 20, 0):
        monkeypatch.setattr(media, "HOT_BYTES", most)
        rows = media.resolve(refs, store).collect()
        assert len(rows) == 2000 and all((r["medium"] is not None) == (r["id"] % 2 == 0) for r in rows)
