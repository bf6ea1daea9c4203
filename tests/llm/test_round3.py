"""Repair, compression bands and prefix trie against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from strandline.llm import compression, prefix_trie, queries, repair

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def talk_dir(spark, tmp_path_factory):
    """Conversations with nulls in every column, ties, repeats, empty and very long texts, odd roles, clashing columns."""
    rng = random.Random(7)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(200 + c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "useful"]), rng.choice(["Yes.", "No!", "What", "", " \n", None, "Yes.", f"t{c}{t}?"])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(300, None, "user", "Early."), (300, None, "user", "Early."), (300, 3, "user", "b."), (300, 3, "assistant", "a."), (None, 1, "user", "No id."), (None, None, None, None), (301, None, None, None), (302, 5, "user", "x. " * 40000)]
    rows += [(400 + i, t, "user" if t % 2 == 0 else "assistant", f"Same {t}.") for i in range(30) for t in range(12)]  # copies
    rows += [(450, t, "user" if t % 2 == 0 else "assistant", f"Same {t}." if t < 7 else f"Other {t}.") for t in range(300)]
    rows += [(-5, 0, "user", "Below zero."), (99_999_999_999, 0, "user", "Far.")]
    where = tmp_path_factory.mktemp("talk")
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int, place string")
    frame.repartition(5).write.parquet(f"{where}/conversations.parquet")
    return str(where), rows


def plain_alignment(letters, faults):
    """Full Wagner-Fischer tables for every length, each cell the least (cost, audit)."""
    best, n = None, len(letters)
    for m in range(0, 2 * n + 3):
        if m == 1:
            continue
        target = "s" * (m % 2) + "ua" * (m // 2)
        cells = {(0, 0): (0, "")}
        for i in range(n + 1):
            for j in range(m + 1):
                ways = [cells[i, j]] if (i, j) in cells else []
                if i and (i - 1, j) in cells:
                    ways.append((cells[i - 1, j][0] + 2, cells[i - 1, j][1] + "D"))
                if j and target[j - 1] != "s" and (i, j - 1) in cells:
                    ways.append((cells[i, j - 1][0] + 5, cells[i, j - 1][1] + "I"))
                if i and j and (i - 1, j - 1) in cells and faults[i - 1] not in ("blank", "duplicate"):
                    cost, audit = cells[i - 1, j - 1]
                    cost += 5 * (faults[i - 1] == "truncated")
                    if letters[i - 1] == target[j - 1]:
                        ways.append((cost, audit + "K"))
                    elif target[j - 1] != "s":
                        ways.append((cost + 1, audit + "R"))
                if ways:
                    cells[i, j] = min(ways)
        if (n, m) in cells and (best is None or cells[n, m] < best):
            best = cells[n, m]
    return best


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_alignment_equals_full_tables(monkeypatch, cells):
    monkeypatch.setattr(repair, "CELLS", cells)
    rng = random.Random(3)
    codes = {"": repair.PLAIN, "blank": repair.BLANK, "truncated": repair.TRUNCATED, "duplicate": repair.DUPLICATE}
    for _ in range(400):
        n = rng.randint(0, 9)
        letters = [rng.choice("uuaas-") for _ in range(n)] if rng.random() < 0.5 else list(("s" * rng.randint(0, 1) + "ua" * n)[:n])
        faults = [rng.choice(["", "", "", "blank", "truncated", "duplicate"]) for _ in range(n)]
        got = repair.aligned("".join(letters).encode(), np.array([codes[f] for f in faults], np.int8))
        assert got == plain_alignment(letters, faults), (letters, faults)


def test_long_alignment_is_the_same_in_blocks(monkeypatch):
    rng = random.Random(4)
    letters = "".join(rng.choice("uaua" * 5 + "s-") if rng.random() < 0.1 else "ua"[i % 2] for i in range(3000)).encode()
    flags = np.array([rng.choice([0] * 20 + [1, 2, 3]) for _ in letters], np.int8)
    whole = repair.aligned(letters, flags)
    monkeypatch.setattr(repair, "CELLS", 1)
    assert repair.aligned(letters, flags) == whole


def plain_repair(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        here = damaged.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        here += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, here in damaged.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in here:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        first = [r[1][:1] for r in here]
        turns = {r[0] for r in here} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = plain_alignment(first, faults) if len(here) < 40 else repair.aligned("".join(c if c in "uas" else "-" for c in first).encode(), np.array([{"": 0, "blank": 1, "truncated": 2, "duplicate": 3}[f] for f in faults], np.int8))
        odd, lines, i = len(audit.replace("D", "")) % 2, [], 0
        for op in audit:
            put = len(lines)
            role, text = (None, "") if op == "I" else here[i][1:]
            i += op != "I"
            if op != "D":
                lines.append(f"{role if op == 'K' else ('user', 'assistant')[(put - odd) % 2]}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_query(spark, talk_dir):
    where, rows = talk_dir
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, where).collect()}
    assert got == plain_repair(rows)
    assert {c for r in got.values() for c in r[6]} == set("DKR")  # a deletion next to it is always cheaper than an insertion


def test_repaired_turns_are_legal(spark, talk_dir):
    where, _ = talk_dir
    rows = repair.prepared(queries.damaged(spark.read.parquet(f"{where}/conversations.parquet")))
    turns = {}
    for r in repair.repaired(rows, repair.audits(rows)).collect():
        turns.setdefault(r.conv, []).append((r.place, r.role[:1]))
    assert all(re.fullmatch("(s?(ua)+)?", "".join(c for _, c in sorted(t))) for t in turns.values())


def test_measures_and_bands(spark):
    rng = random.Random(2)
    clean = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(6000))
    texts = [None, "", " \n\t", "one", "a b c d", "a a a a", "x y z x y z w", "l1\nl1\n \nl1 \n\n", "é # ü$ %|<>&*", clean, "For " * 9000, clean[:9000] + "For " * 3000, clean[:9000] + noise + clean[:9000], noise, clean + " one\xa0word", "\n".join(["same line"] * 40)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts, texts[9]])], "doc_id long, text string, ratio string, bands string")
    got = {r.doc_id: r.m for r in compression.measured(docs, "m").collect()}
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, w in enumerate(windows) if len(words) < 4000 and windows.count(w) > 1 for d in range(3)}
        lines = (t or "").split("\n")
        copies = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        assert got[i][:2] == (len(words), sum(map(len, words))) and got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and got[i].n_dup_lines == copies
        assert len(words) >= 4000 or got[i].n_repeat_words == len(covered)
        assert got[i].ratio == (len(pack.compress(t.encode())) / len(t.encode()) if t else 1.0)
    assert got[16] == got[9] and [got[i].in_band for i in (9, 10, 11, 12, 13, 14)] == [True, False, False, False, False, True]
    kept = compression.kept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [9, 14, 16]
    assert compression.kept(docs.limit(0)).count() == 0


def test_compression_query_leaves_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op12_compression(spark, sf).collect()
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed)
    assert sum(not r.kept for r in rows if labels.get(r.doc_id) == 0) > 0.5 * sum(labels.get(r.doc_id) == 0 for r in rows)


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    members = {}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[p] if whole[c] == p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_trie(spark, talk_dir, most):
    where, rows = talk_dir
    keys = prefix_trie.placed(prefix_trie.turn_keys(spark.read.parquet(f"{where}/conversations.parquet").where("conv_id < 440 or conv_id > 460 or turn < 20")))
    found = prefix_trie.nodes(queries.rebuilt(keys), keys.select("conv_id"), most=most)
    want = plain_trie([r for r in rows if r[0] is not None and (r[0] < 440 or r[0] > 460 or r[1] < 20)])
    assert sorted(map(tuple, found.collect())) == want
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query(spark, talk_dir):
    where, rows = talk_dir
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, where).collect())) == plain_trie(rows)


def test_new_queries_on_empty_tables(spark, talk_dir, tmp_path):
    spark.read.parquet(f"{talk_dir[0]}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_repair(spark, str(tmp_path)).count() == queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_staged_tables_of_another_thread_stay(spark):
    """A scratch deletes what its own thread staged, not what others stage meanwhile."""
    import threading

    from strandline.llm import staging

    opened, done, found = threading.Event(), threading.Event(), {}

    def other():
        opened.wait(60)
        found["table"] = staging.staged(spark.range(7).toDF("x"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with staging.scratch(spark) as kept:
        mine = staging.staged(spark.range(3).toDF("x"))
        named = kept(staging.staged(spark.range(4).toDF("x")))
        opened.set()
        assert done.wait(60)
    thread.join()
    assert found["table"].count() == 7 and named.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        mine.collect()


def test_language_model_of_repeated_rows(spark):
    from strandline.llm import language

    for text in ("hello there", "guten Tag an alle", "x"):
        docs = spark.createDataFrame([(1, text, "en")] * 900, "doc_id long, text string, lang string")
        rows = language.identify(docs, language.fit(docs), "l").collect()
        assert {r.l.lang_pred for r in rows} == {"en"} and len(rows) == 900
    two = spark.createDataFrame([(1, "hello there world", "en")] * 900 + [(2, "guten tag welt", "de")] * 3, "doc_id long, text string, lang string")
    assert {(r.lang, r.l.lang_pred) for r in language.identify(two, language.fit(two), "l").collect()} == {("en", "en"), ("de", "de")}


def test_contexts_by_words():
    from strandline.llm import pii

    at = lambda text: {m["instance"]: m["patterns"] for m in pii.mentions(text)}
    wide = at("Please  write" + " " * 300 + "to me@x.org" + "\n" * 200 + "or call")
    assert wide["me@x.org"] == ["write to _", "to _ or", "_ or call"]
    assert at("<me@x.org>, now")["me@x.org"] == ["^ < _", "< _ >,", "_ >, now"]
    assert at("me@x.org")["me@x.org"] == ["^ ^ _", "^ _ $", "_ $ $"]
    long = at("y" * 5000 + " me@x.org")["me@x.org"]
    assert long[0] == "^ " + "y" * pii.NEAR + " _"


def test_seeds_of_two_kinds(spark):
    """A number that is a card in one place and part of an address in another counts for both kinds."""
    from strandline.llm import pii

    rows = [(i, f"pay with {c} today") for i, c in enumerate(("4465758382889437", "4012888888881881", "4111111111111111"))]
    rows += [(10 + i, f"host 10.0.0.{i} answered quickly") for i in range(4)] + [(20, "host fe80::1234 answered quickly"), (21, "pay with 77-1234-0 today")]
    found = {r.doc_id: r.spans for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x.kind for x in found[20]] == [1] and [x.kind for x in found[21]] == [2]


def test_article_text_of_formulas_and_objects():
    from strandline.llm import html_text

    page = '<article><p>area <math><mi>x</mi><mo>+</mo><mn>1</mn></math> end</p><object data="x"><p>instead</p></object><p>A <span aria-hidden="true">seen</span> word</p><video>no film</video></article><div aria-hidden="true">outside</div>'
    assert html_text.main_text(page) == "area x+1 end\n\ninstead\n\nA seen word\n\nno film"


@pytest.mark.parametrize("length", [7, 151])
def test_suffix_lengths_out_of_range_are_refused(spark, length):
    from strandline.llm import suffix_dedup

    with pytest.raises(ValueError, match="length"):
        suffix_dedup.spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=length)
