"""Corpus operators against brute-force versions on small tables with hard rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from strandline.llm import components, decontaminate, html_text, jaccard_join, language, lm, mixing, neighbours, pii, quality, suffix_dedup, textbytes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, n):
    w = WORD.findall(lower(t))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.fixture(scope="module")
def hard(spark):
    """Real rows with nulls, empty and white texts, repeated rows, a very long text, ties and clashing extra columns."""
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    long = " ".join(f"word{i % 997} Und{i % 31}" for i in range(20000))
    odd = [(900, None, "en", "src0"), (901, "", "en", None), (902, " \n\t ", None, "src1"), (903, "one", "en", "src1"), (904, long, "en", "src2"), (905, long + " tail", "en", "src2"), (None, "no id here at all", None, None), (base[3][0] + 2000, base[3][1], "fr", None)]
    rows = [(*r, "x", 1) for r in [*base, *odd, base[7], base[7]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, node int")


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["A b\x0bC", None, "", "  x  ", "a b c", "é É"]
    data, offsets = textbytes.buffers(pa.array(texts))
    hashes, ranges = textbytes.word_hashes(data, offsets)
    assert np.diff(ranges).tolist() == [3, 0, 0, 1, 3, 1]
    assert hashes[:3].tolist() == hashes[4:7].tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, hard, n, num):
    rows = [(r.doc_id, shingle_set(r.text, n)) for r in hard.collect()]
    near = [[b for b, y in enumerate(rows) if rows[a][1] and 100 * len(rows[a][1] & y[1]) >= num * len(rows[a][1] | y[1])] for a in range(len(rows))]
    want = []
    for a, (doc, s) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        want.append((str(doc), len(s), min(ids) if ids else None))
    got = [(str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(hard, n=n, num=num).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_keep_one(spark, hard):
    kept = jaccard_join.keep_one(hard)
    assert kept.columns == hard.columns
    groups = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(hard, n=5, num=80).collect() if r.n_shingles}
    wordless = hard.where("text is null or trim(translate(text, '\n\t', '  ')) = ''").count()
    assert kept.count() == len({g for _, g in groups}) + wordless
    assert jaccard_join.keep_one(hard.limit(0)).count() == 0


def test_near_copies_keep_all_links(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[:k], f"edit{k}", *words[k + 1 :]])) for k in range(0, 120, 2)]
    docs = spark.createDataFrame([(500, " ".join(words)), *rows], "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, n=3, num=90).collect()
    assert {r.component_id for r in got} == {0}


def test_leaks(spark, hard):
    items = [(1, " ".join(f"word{i} Und{i}" for i in range(20, 30))), (2, "one"), (3, None), (4, ""), (5, "no id here at all"), (5, "no id here at all"), (6, "word1 Und1 word2 Und2 other")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in hard.collect():
        s = shingle_set(r.text, 5)
        for i, t in items:
            q = shingle_set(t, 5)
            if q and 100 * len(q & s) >= 80 * len(q):
                want.append((str(r.doc_id), i, len(q), len(q & s)))
    got = [(str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in decontaminate.leaks(hard, bench).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 5
    small = [(str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in decontaminate.leaks(hard, bench, block_chars=50).collect()]
    assert sorted(small) == sorted(want)
    clean = decontaminate.uncontaminated(hard, bench)
    assert clean.columns == hard.columns and clean.count() == hard.count() - len({d for d, *_ in want})
    assert decontaminate.leaks(hard, bench.limit(0)).count() == 0


def test_language(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(language.remainder("doc_id", 3) != 1))
    found = language.identify(docs, model, "x").where(language.remainder("doc_id", 3) == 1).collect()
    assert np.mean([r.x.lang_pred == r.lang for r in found]) > 0.97
    assert sum(r.x.rejected for r in found) == 0
    odd = {r.doc_id: r.x for r in language.identify(hard, model, "x").collect()}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0, True)
    junk = spark.createDataFrame([(1, "漢字" * 200)], "doc_id long, text string")
    assert language.identify(junk, model, "x").first().x.rejected
    assert language.identify(hard.limit(0), model, "x").count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    texts = [
        "a@b.c x@@y.z.w q@w a.b@c-d.ef, 1.2.3.4.5.6.7.8 300.1.1.1 4465758382889437 +1 (743) 555-3824 +1 2", "@a.b x+y@z..w a@b.c@d.e", "1-2-3 4111 1111 1111 1111 1.1.1.1", "é +44 20 7946 0958 99 001.002.003.004",
        "x" * 3000 + "@" + "9" * 3000 + ".1.2.3", "+1+1-234-567-8901.", "a@b.c.d@e.f.g",
    ]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_discovery_and_redaction(spark):
    rows = [(i, f"please call badge number {4000000000000 + i * 7} today +1 (743) 555-38{i:02d} ok") for i in range(3)]
    rows = [(i, f"contact phone line +1 (743) 555-38{i:02d} now") for i in range(10, 20)] + [(50, "contact phone line 555-0199-77 now"), (51, None), (52, ""), (53, "room 12345 is free")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    found = {r.doc_id: r for r in pii.with_spans(docs).collect()}
    assert [tuple(x) for x in found[50].spans] == [(19, 3, 30)] and not found[50].base
    assert not found[53].spans and not found[51].spans and len(found[12].base) == 1
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[50] == "contact phone line [PHONE] now" and red[51] is None and red[53] == "room 12345 is free"
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_ordinary_numbers_stay_in_a_patterns_mean(spark):
    rows = [(i, f"contact phone line +1 (743) 555-38{i:02d} now") for i in range(10, 20)]
    rows += [(i + 100, f"order number +1 (743) 555-38{i:02d} due") for i in range(10, 13)]
    rows += [(1000 + i, f"order number {700000 + i} due") for i in range(1000)] + [(50, "contact phone line 555-0199-77 now")]
    found = {r.doc_id: r for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[1000 + i].spans for i in range(1000))
    assert len(found[50].spans) == 1 and len(found[110].spans) == 1


def test_mixing(spark, hard):
    mixed = mixing.mix(hard).collect()
    assert len(mixed) == hard.count()
    sizes, taken, target = {}, {}, {}
    for r in mixed:
        assert r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in mixed)
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2] * 99, strict=False))
    level, full = 0.0, set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in sizes:
        assert target[s] == pytest.approx(min(2 * sizes[s], level * weight[s]))
    key = lambda rows: sorted((str(r.doc_id), r.copies) for r in rows)
    assert key(mixed) == key(mixing.mix(hard.repartition(7)).collect())
    assert mixing.taken(hard).count() == sum(r.copies for r in mixed)
    assert mixing.mix(hard.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((800, 16)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), top=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 800, 20))
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(800), -s))[:10]
        assert sorted(found) == list(range(1, 11))
        assert all(score == pytest.approx(s[v]) for v, score in found.values())
        hit += len(set(want) & {v for v, _ in found.values()})
    assert hit / (10 * len(got)) > 0.9


def test_quality(spark, hard):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where(language.remainder("doc_id", 4) != 2))
    rows = quality.scored(docs, model).join(labels, "doc_id").where(language.remainder("doc_id", 4) == 2).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.quality) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.scored(hard.drop("score"), model).collect())


def test_nothing_to_learn_from(spark, tmp_path):
    import corpus_pipeline
    from strandline.llm import queries

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unknown = docs.limit(5).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    for name, rows, n in (("empty", docs.limit(0), 0), ("unknown", unknown, 5)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = queries.op2_language_id(spark, f"{tmp_path}/{name}").collect()
        assert [(r.lang_pred, r.score, r.rejected) for r in found] == [("und", 0.0, True)] * n
        assert [r.score for r in queries.op7_quality(spark, f"{tmp_path}/{name}").collect()] == pytest.approx([0.5] * n)
        assert corpus_pipeline.language_stage(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), "").count() == 0
    odd = labels.limit(3).withColumn("doc_id", labels.doc_id + 1000000)
    assert [r.score for r in quality.scored(unknown, quality.fit(unknown, odd)).collect()] == pytest.approx([0.5] * 5)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    s, a = rng.normal(size=5), rng.normal(size=(2, 2))
    weight, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(s[i] for i in range(5) if y[i]) + sum(a[y[i], y[i + 1]] for i in range(4)))
        weight += w
        good += w * np.array(y)
    found, _ = quality.marginals([s, s[:3]], a)
    assert np.allclose(found[0], good / weight)


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one<br>two<p>th<i>re</i>e&nbsp;x<script>var t="</p>";</script><div id="comments"><p>hi</p></div><ul><li>x<li>y</ul></article><footer>f</footer>'
    assert html_text.main_text(page) == "A & B\n\none two\n\nthree x\n\nx\n\ny"
    assert html_text.main_text("") == "" and html_text.main_text("a < b <!-- c") == "a < b"
    assert html_text.main_text("<div " * 3000) is not None


def test_whole_attribute_names():
    for a in ('style="overflow:hidden"', 'title="a hidden gem"', 'data-id="ad-1"', "data-role='search' x-class=ad", 'data-x=id=ad', 'title="x" / alt=\'class="ad"\'', 'href=/a/id/ad', 'class="body" class="ad"', 'class id = "x1"'):
        assert html_text.main_text(f"<div {a}><p>kept</p></div>") == "kept", a
    for a in ("hidden", "HIDDEN=''", 'style="overflow:hidden" hidden', 'title="id" CLASS = "x ad"', "id=ad", 'a="b"class="ad"', "role = 'search'", "aria-hidden=true", "/hidden", "class='ad"):
        assert html_text.main_text(f"<p>kept</p><div {a}><p>gone</p></div>") == "kept", a


def test_templates(spark):
    rows = [(i, "http://h.com/a", f"<body><div><p>follow us</p></div><article><p>text {i}</p><p>stay tuned</p></article></body>") for i in range(12)]
    rows += [(50, "http://h.com/b", rows[0][2])] * 30 + [(60, None, None), (61, "http://o.com", "<p>alone</p>")]
    got = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3" and got[50] == "text 0" and got[60] == "" and got[61] == "alone"


def test_templates_of_a_large_host(spark):
    side = "<section><p>stay tuned</p></section>"
    rows = [(i, f"http://h.com/{i}", f"<body>{side if i % 5 == 0 else ''}<p>text {i}</p>{'<p>quoted</p>' if i % 25 == 1 else ''}</body>") for i in range(1000)]
    got = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" + ("\n\nquoted" if i % 25 == 1 else "") for i in range(1000)}


def test_lm(spark, hard):
    docs = hard.withColumn("held", language.remainder("doc_id", 7) == 2)
    rows = docs.collect()
    tok = [[*lower(r.text).encode().split(), None] for r in rows]
    count = {}
    for r, t in zip(rows, tok, strict=True):
        if not (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2):
            for w in t:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    want = sorted((str(r.doc_id), len(t), sum(w in count for w in t), round(sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in t), 4)) for r, t in zip(rows, tok, strict=True))
    got = lm.scored(docs, "held", batch_bytes=100_000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == total for r in got)


@pytest.mark.parametrize("length", [100])
def test_suffix_dedup(spark, hard, length):
    docs = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    extra = spark.createDataFrame([(3000, "ab" * 400, "", "", "", 0), (3001, "x" + "ab" * 300, "", "", "", 0), (3002, "é" * 120, "", "", "", 0)], hard.schema)
    docs = docs.union(extra)
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                mark[s : s + length] = b"\1" * length
            else:
                seen.add(b[s : s + length])
        kept = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        want[r.doc_id] = (len(b), sum(mark), sum(1 for i, y in enumerate(mark) if y and (i == 0 or not mark[i - 1])), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.cut.n_removed, r.cut.n_spans, hashlib.sha256(r.cut.kept).hexdigest()) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == want
    assert suffix_dedup.deduplicated(hard).count() == hard.count()


def test_blind_tries_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2500] = data[:1000]
    starts = np.arange(2900)
    got = sorted(sorted(c.tolist()) for c in suffix_dedup.equal_classes(data, starts, 100, shallow=8))
    by = {}
    for s in starts:
        by.setdefault(data[s : s + 100].tobytes(), []).append(int(s))
    assert got == sorted(v for v in by.values() if len(v) > 1)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(docs.columns) <= set(rows[0].asDict())
    known = {r.doc_id: r for r in docs.collect()}
    items = [q for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (q := shingle_set(r.text, 5))]
    once = {r.doc_id: r for r in rows}
    for r in once.values():
        text = known[r.doc_id].text
        assert not plain_spans(r.text) and (r.text == text or "[" in r.text)
        s = shingle_set(text, 5)
        assert not any(100 * len(q & s) >= 80 * len(q) for q in items)
        assert r["size"] == len(WORD.findall(r.text or ""))
    sets = [shingle_set(known[d].text, 5) for d in once]
    for k, a in enumerate(sets):
        assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for b in sets[:k])
