"""The registered queries on hard tables: nulls, repeats, clashing columns, very long texts, empty tables."""

import hashlib
import zlib

import pytest
from test_llm import hard, lower, plain_spans, WORD  # noqa: F401

from strandline.llm import pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard_dir(spark, hard, tmp_path_factory):  # noqa: F811
    """A folder of tables whose documents are hard's rows and some with personal data."""
    where = tmp_path_factory.mktemp("hard")
    extra = spark.createDataFrame(
        [(5000, "mail a.b@c-d.ef from 1.2.3.4, card 4465758382889437 or +1 (743) 555-3824 ü", "en", "src0", "x", 1), (5001, "é 1.2.3.4 5.6.7.8 q@w.de q@w.de", "en", "src1", "x", 1)],
        "doc_id long, text string, lang string, source string, score string, node int",
    )
    hard.unionByName(extra).coalesce(3).write.parquet(f"{where}/documents.parquet")
    for name in ("benchmark", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def empty_dir(spark, hard, tmp_path_factory):  # noqa: F811
    where = tmp_path_factory.mktemp("empty")
    hard.limit(0).withColumn("n_chars", hard.doc_id).write.parquet(f"{where}/documents.parquet")
    for name in ("benchmark", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["op2_language_id", "op3_pii", "op4_jaccard_join", "op5_mixing", "op7_quality", "op9_lm_score", "op10_suffix_dedup"])
def test_one_row_for_each_document(spark, hard_dir, name):
    ids = sorted(str(r.doc_id) for r in spark.read.parquet(f"{hard_dir}/documents.parquet").collect())
    assert sorted(str(r.doc_id) for r in queries.QUERIES[name](spark, hard_dir).collect()) == ids


@pytest.mark.parametrize("which", ["hard", "sf0.01"])
def test_pii_columns(spark, hard_dir, which):
    sf = hard_dir if which == "hard" else "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in queries.op3_pii(spark, sf).collect():
        want = plain_spans(texts[r.doc_id])
        seen += len(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)], r.doc_id
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert seen


def test_held_out_columns(spark, hard_dir):
    for name, mod, rest in (("op2_language_id", 3, 1), ("op7_quality", 4, 2), ("op9_lm_score", 7, 2)):
        for r in queries.QUERIES[name](spark, hard_dir).collect():
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == rest)
            if name == "op7_quality":
                assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1


def test_suffix_query(spark, hard_dir):
    """Hash, spans and removed bytes against a plain scan of all strings in order."""
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in spark.read.parquet(f"{hard_dir}/documents.parquet").collect()}, key=lambda x: x[:2])
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, hard_dir).collect()}
    seen = set()
    for some, doc, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(s)
        r = got[doc if some else None]
        assert (r.n_bytes, r.n_removed) == (len(data), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()
        assert r.n_spans == sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def test_discovery_on_several_templates(spark):
    """Unseen identifiers in two templates of each kind are found; numbers in other sentences are not."""
    rows = []
    for i in range(30):
        rows += [(4 * i, f"Write to user{i}@mail{i % 7}.example.com for more. Call +1 (743) 555-{3800 + i} at night."), (4 * i + 1, f"The server at 10.0.{i}.{i + 3} was slow; reply via u{i}@host.example.org soon.")]
        rows += [(4 * i + 2, f"In the year {1800 + i} about {50000 + i * 7} people lived there."), (4 * i + 3, f"Invoice {880000 + i} was paid.")]
    rows += [(900, "Write to someone(at)nowhere2024 for more."), (901, "Call 0743-555-3999 at night."), (902, "The server at fe80::1234 was slow;")]
    found = {r.doc_id: r for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(found[k].spans) for k in (901, 902)] == [1, 1]
    assert not any(found[4 * i + k].spans for i in range(30) for k in (2, 3))
    assert all(len(found[4 * i].spans) == 2 for i in range(30))


@pytest.mark.parametrize("crowd", [3, 40])
def test_crowded_anchors_are_split(spark, crowd):
    """A passage with different surroundings in every text: the same result as without a split."""
    import random

    from strandline.llm import suffix_dedup

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 40))), passage, *(word() for _ in range(rng.randint(0, 40)))]) for _ in range(60)]
    texts += ["-" * 700, "x" + "-" * 500, passage[40:] + passage[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    cut = lambda **o: sorted((r.doc, r.tie, r.lo, r.hi) for r in suffix_dedup.spans(docs, **o).collect())

    def covered(rows):
        return {(d, x) for d, _, a, b in rows for x in range(a, b)}

    seen, want = set(), set()
    for d, t in enumerate(texts):
        b = t.encode()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                want |= {(d, x) for x in range(i, i + 100)}
            seen.add(b[i : i + 100])
    assert covered(cut(crowd=crowd)) == want == covered(cut())


def test_removal_rests_on_the_sort(spark, hard_dir, monkeypatch):
    """Without the order of suffixes, repeats with different surroundings are missed."""
    import numpy as np

    from strandline.llm import suffix_dedup

    docs = spark.createDataFrame([(i, f"{chr(97 + i) * 30} " + " ".join(f"w{k * k}" for k in range(60)) + chr(105 + i) * 40) for i in range(3)], "doc_id long, text string").repartition(3)
    assert sum(r.cut.n_removed for r in suffix_dedup.deduplicated(docs).collect()) > 0
    empty = np.zeros(0, np.int64)
    table = suffix_dedup._repeats(100)
    import pyarrow as pa

    one = (b"x" * 20 + bytes(range(60, 180)), b"y" * 20 + bytes(range(60, 180)))
    rows = pa.table({"doc": [1, 2], "tie": [0, 0], "lo": [0, 0], "n": [41, 41], "bytes": list(one)})
    assert table(rows).num_rows == 1
    monkeypatch.setattr(suffix_dedup, "sorted_classes", lambda *a, **k: (empty, empty))
    assert table(rows).num_rows == 0


def test_lm_score_equals_a_plain_model(spark, hard_dir):
    """The query's score against a token-by-token computation from the trained weights and plain counts."""
    import math

    import numpy as np

    from strandline.llm import language, lm, textbytes

    docs = spark.read.parquet(f"{hard_dir}/documents.parquet").select("doc_id", "text", (language.remainder("doc_id", 7) == 2).alias("held"))
    rows = docs.collect()
    weights = lm.train(docs.where("not held").select(textbytes_text()))
    size = len(weights) - 1
    assert lm.LEAST_ROWS <= size <= lm.MOST_ROWS and size & size - 1 == 0

    def parsed(text):
        data, offsets = textbytes.buffers(__import__("pyarrow").array([text or ""]))
        return lm.tokens(data, offsets)

    counts, kinds, per_class = {}, {}, {}
    for r in rows:
        if not r.held:
            tok, cls, _ = parsed(r.text)
            for t, c in zip(tok.tolist(), cls.tolist(), strict=True):
                counts[t] = counts.get(t, 0) + 1
                kinds[t] = c
                per_class[c] = per_class.get(c, 0) + 1
    distinct = {c: sum(1 for k in kinds.values() if k == c) for c in range(64)}
    want = []
    for r in [x for x in rows if len(x.text or "") < 20000]:
        tok, cls, bounds = parsed(r.text)
        feats = lm.features(tok, bounds, size)
        total = 0.0
        for i, (t, c) in enumerate(zip(tok.tolist(), cls.tolist(), strict=True)):
            w = weights[0].astype(float) + sum(weights[1 + f].astype(float) for f in feats[:, i])
            one, two = w[:8], w[8 + 8 * (c // 8) : 16 + 8 * (c // 8)]
            total += one[c // 8] - np.log(np.exp(one).sum()) + two[c % 8] - np.log(np.exp(two).sum())
            total += math.log((counts.get(t, 0) + 1) / (per_class.get(c, 0) + distinct[c] + 1))
        want.append((str(r.doc_id), total / math.log(10)))
    got = sorted((str(r.doc_id), r.score) for r in queries.op9_lm_score(spark, hard_dir).collect() if r.n_tokens < 5000)
    want = sorted(want)
    assert [x for x, _ in got] == [x for x, _ in want] or {x for x, _ in want} <= {x for x, _ in got}
    known = dict(got)
    assert all(abs(known[d] - s) < 1e-3 * max(1, abs(s)) for d, s in want)


def textbytes_text():
    from pyspark.sql import functions as F

    return F.coalesce("text", F.lit("")).alias("text")


def test_long_malformed_pages_take_linear_time():
    import time

    from strandline.llm import html_text

    for page in ("<div>" * 12000 + "</b>" * 12000 + "x", "<p a=\"x " * 8000, "<div class='" * 8000 + ">", "<a <b " * 8000, "<ul>" + "<li>x" * 20000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 3


def test_marks_inside_an_article():
    from strandline.llm import html_text

    page = '<body><header>site</header><article><header><h1>Head</h1></header><div class="alert-history">a</div><section id="search"><p>b</p></section><div class="ad">c</div><div class="comments">d</div><form>e</form></article></body>'
    assert html_text.main_text(page) == "Head\n\na\n\nb"


def test_clashing_columns_stay(spark):
    """Columns named like the operators' inner ones come through unchanged."""
    from pyspark.sql import functions as F

    from strandline.llm import decontaminate, html_text, jaccard_join, language, mixing, quality

    names = "_text _key _more _kept _times _node _row _other _host _template _each _s _place _leaks base spans _class _source _own _before _begin".split()
    rows = spark.createDataFrame([(i, f"w{i} some words that stand here {i * 3} a b c", "src0") for i in range(6)], "doc_id long, text string, source string")
    docs = rows.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    bench = spark.createDataFrame([(1, "nothing of that sort is in there")], "item_id long, text string")
    pages = docs.withColumns({"html": F.concat(F.lit("<article>"), "text"), "url": F.lit("http://a.b/c")})
    found = [
        pii.redacted(docs), jaccard_join.keep_one(docs), decontaminate.uncontaminated(docs, bench), decontaminate.uncontaminated(docs, bench, block_chars=5), mixing.mix(docs), html_text.extract(pages),
        language.identify(docs, language.fit(docs.withColumn("lang", F.lit("en")))), quality.scored(docs, quality.fit(docs, rows.select("doc_id", F.lit(1).alias("quality")))),
    ]
    for df in found:
        got = df.collect()
        assert len(got) == 6
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
