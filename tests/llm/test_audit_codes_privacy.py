"""Source divergence, vector codes and personal data against plain definitions on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtally.llm import divergence, personal_data, vector_codes
from boxtally.llm.common import table

DOCS = "doc_id long, text string, lang string, source string"
VECTORS = "vec_id long, embedding array<double>, label int"


# -- divergence ---------------------------------------------------------------

def audit_by_hand(rows, min_docs, top):
    seen, counts = Counter(), Counter()
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, text, lang, source in rows:
        words = re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        seen.update({(lang or "", w) for w in words})
        counts.update((lang or "", source or "", w) for w in words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (of, w), n in seen.items() if of == lang and n >= min_docs]
        mine = sorted(s for of, s in groups if of == lang)

        def rates(table, kept=kept):
            size = sum(table.values())
            return {w: 1 + 10**9 * (table[w] + 5) // (size + 5 * len(kept)) for w in kept}

        by = {s: Counter({w: counts[lang, s, w] for w in kept}) for s in mine}
        p, q = {s: rates(by[s]) for s in mine}, rates(sum(by.values(), Counter()))
        for s in mine:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in mine if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if by[s][w] and p[s][w] > q[w])
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(terms[:top], 1)}
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    words = ["Ä", "ä", "one", "TWO", "two", "three", "x1y", "née", "日本", "four", "five"] + [f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8]}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None]),
             rng.choice(["a", "a", "a", "b", "c", "", None, "é"])) for i in range(200)]
    return rows + [(7, None, "en", "empty"), (7, None, "en", "empty"), (8, "rare", "solo", "s"), (9, "", "solo", "t"), (None, "one " * 5000, "en", "a")]


@pytest.mark.parametrize("block, tile", [(512, 128), (7, 2)])
def test_audit_equals_definition(spark, talk, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    docs = spark.createDataFrame(talk, DOCS).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "block", "v", "size")})
    got = [tuple(r) for r in divergence.audit(docs.repartition(5), 6, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(talk, 6, 8)
    solo = [r for r in got if r[0] == "solo"]
    assert sorted(solo) == [("solo", "s", "pair", "t", 0, 1), ("solo", "t", "pair", "s", 0, 1)]


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_counts_leave_the_range_of_long(spark):
    row = spark.createDataFrame([(2 * 10**10, 3 * 10**10, 7)], "n long, size long, v long")
    assert row.select(divergence._rate("n", "size")).first()[0] == 1 + 10**9 * (2 * 10**10 + 5) // (3 * 10**10 + 35)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    raw = b"aa bbbbbbbbbbbb c  dd e" * 20
    assert b"".join(divergence._pieces(raw)) == raw
    assert sum((p.split() for p in divergence._pieces(raw)), []) == raw.split()


# -- vector codes -------------------------------------------------------------

def codes_by_hand(rows):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [np.array([[math.floor(4096 * x) for x in r[1]] for r in kept], dtype=object).reshape(len(kept), -1)[
        :, p * len(kept[0][1]) // 8:(p + 1) * len(kept[0][1]) // 8].astype(np.int64) for p in range(8)]
    books = [p[:16].copy() for p in parts]

    def nearest(p):
        d = ((parts[p][:, None] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(6):
        for p in range(8):
            own = nearest(p)[0]
            books[p] = np.array([parts[p][own == e].sum(0) // (own == e).sum() if (own == e).any() else books[p][e]
                                 for e in range(len(books[p]))])
    found = [nearest(p) for p in range(8)]
    error = sum(e for _, e in found)
    labels = Counter()
    for r, e in zip(kept, error):
        labels[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{c[i]:02x}" for c, _ in found), int(error[i]), labels[r[2]], digest)
                  for i, r in enumerate(kept))


@pytest.mark.parametrize("size, width, copies", [(400, 16, 0), (300, 8, 200), (5, 24, 3), (40, 0, 0)])
def test_codes_equal_definition(spark, size, width, copies):
    rng = random.Random(size)
    rows = [(rng.randrange(2 * size), [rng.gauss(rng.choice([-1, 0, 2]), 0.2) for _ in range(width)], rng.choice([1, 2, None])) for _ in range(size)]
    rows += [(size + i, rows[0][1], 1) for i in range(copies)]
    rows += [(0, None, 1), (1, [None] * max(1, width), 1), (2, [float("nan")] * max(1, width), 2), (3, [float("inf")] * max(1, width), 2),
             (None, [0.25] * width, 3)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("code", "error", "part", "of")})
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256)
                 for r in vector_codes.compress(df.repartition(3)).collect())
    assert got == codes_by_hand(rows)


def test_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_uneven_vectors_are_refused(spark):
    for bad in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="component"):
            vector_codes.compress(spark.createDataFrame(bad, VECTORS)).collect()


@pytest.mark.parametrize("size, width, spread", [(1, 8, 9), (3000, 8, 400), (900, 2, 2)])
def test_trees_prune_and_stay_exact(size, width, spread):
    rng = np.random.default_rng(size)
    points = rng.integers(-spread, spread, (size, width)) + 3000 * rng.integers(0, 9, (size, 1))
    tree = vector_codes.Tree.load(vector_codes.plant(points).dump())
    book = np.vstack([points[:15], points[:1]])
    d = ((points[:, None] - book[None]) ** 2).sum(2)
    code, error = vector_codes.part_codes(tree, book)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    sums, counts = vector_codes.part_sums(tree, book)
    assert (counts == np.bincount(d.argmin(1), minlength=len(book))).all()
    assert all((sums[e] == points[d.argmin(1) == e].sum(0)).all() for e in range(len(book)))
    looked = []
    vector_codes.descend(tree, points[rng.choice(size, 9)], lambda n, e: None, lambda at, e: looked.append(len(at)))
    assert size < 3000 or sum(looked) < size  # some balls were handed over whole


# -- personal data ------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    bits = ["1", "12", "255", "256", "0001", "4111", "@", "a", ".", "-", " ", "+", "(", ")", "é", "a.b", "x@y.zz", "1.2.3.4",
            "+1 (826) 555-4081", "4432507379035540", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert personal_data.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1.2." * 60_000, "+1" + "(" * 200_000, "a@" * 20_000, "1 " * 20_000,
                                  "x" * 200_000 + " (at) " + "b" * 200_000])
def test_long_texts_in_linear_time(text):
    import time

    field = personal_data.Field({"number": np.zeros(4), "mail": np.zeros(4)}, np.zeros((5, 5)))
    start = time.time()
    field.added(text, personal_data.base_spans(text))
    assert time.time() - start < 20


def test_best_path_and_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(30):
        cuts = sorted(rng.choice(12, 5, replace=False).tolist())
        pairs = [(a, b) for a in cuts for b in cuts if a < b]
        segments = [personal_data.Segment(*pairs[i], bool(rng.integers(2)), (f"f{i}",)) for i in rng.choice(len(pairs), 4, replace=False)]
        weights, steps = {f"f{i}": rng.normal(0, 2, 4) for i in range(len(pairs))}, rng.normal(0, 1, (5, 5))
        grid = personal_data.Lattice(segments)
        scores = grid.scores(weights)
        paths = []

        def walk(node, label, value, taken):
            if node == grid.size - 1:
                paths.append((value, tuple(taken)))
                return
            walk(node + 1, 0, value + steps[label, 0], taken)
            for k in range(len(segments)):
                if grid.start[k] == node:
                    for y in range(4):
                        if grid.allowed[k, y]:
                            walk(int(grid.end[k]), 1 + y, value + steps[label, 1 + y] + scores[k, y], [*taken, (k, y)])

        walk(0, 0, 0.0, [])
        total, share, moved = grid.marginals(scores, steps)
        assert total == pytest.approx(np.logaddexp.reduce([v for v, _ in paths]))
        for k in range(len(segments)):
            for y in range(4):
                assert share[k, y] == pytest.approx(sum(np.exp(v - total) for v, t in paths if (k, y) in t), abs=1e-9)
        assert tuple(grid.best(scores, steps)) == max(paths)[1]
        assert moved.sum() == pytest.approx(sum(np.exp(v - total) * (len(t) + sum(
            1 for n in range(grid.size - 1) if not any(grid.start[k] <= n < grid.end[k] for k, _ in t))) for v, t in paths))


def test_find(spark, sf_dir):
    """Held-out documents: other forms of their spans are found, spoiled ones and all else left alone."""
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    field = personal_data.train(docs.where("doc_id % 2 = 0"))
    held = [r.text for r in docs.where("doc_id % 2 = 1").collect()]
    got, bad = Counter(), Counter()
    for text in held:
        base = personal_data.base_spans(text)
        assert all(s[1] == personal_data.CARD for s in field.added(text, base))
        for start, kind, end in base:
            left, right = text[max(0, start - 30):start], text[end:end + 30]
            good, spoiled = personal_data._respelled(kind, text[start:end])
            for form in good:
                spans = personal_data.base_spans(left + form + right)
                got[(len(left), kind, len(left) + len(form)) in spans + field.added(left + form + right, spans)] += 1
            for form in spoiled:
                text_ = left + form + right
                spans = personal_data.base_spans(text_)
                bad[any(s[0] < len(left) + len(form) and s[2] > len(left) for s in field.added(text_, spans))] += 1
    assert got[True] >= 0.95 * (got[True] + got[False]) > 0 and bad[True] <= 0.02 * (bad[True] + bad[False])


def test_find_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no data here"), (4, "mail x.y@z.example.org or +1 (826) 555-4081, 10.0.0.1; 4432507379035540"),
            (4, "mail x.y@z.example.org or +1 (826) 555-4081, 10.0.0.1; 4432507379035540"), (None, "é 1.2.3.4" + " word" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("spans", "n_ip", "feature")})
    out = {r.doc_id: r for r in personal_data.find(docs).collect()}
    assert out[4].spans == "email:5:22,phone:26:43,ip:45:53,card:55:71" and (out[4].n_email, out[4].n_ip, out[4].n_card, out[4].n_phone) == (1, 1, 1, 1)
    assert out[None].spans == "ip:2:9" and {out[k].spans for k in (1, 2, 3)} == {""}
    assert out[4].base_sha256 == hashlib.sha256(out[4].spans.encode()).hexdigest()
    assert out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data.find(docs.limit(0)).count() == 0
    assert personal_data.find(spark.createDataFrame([(1, "nothing 12")], "doc_id long, text string")).first().n_added == 0


# -- earlier operators: broken pages, numerals, many hits in one text -----------

@pytest.mark.parametrize("page", ["<a b " * 200_000, "<a x='" * 170_000, "<a<" * 300_000, "<a " + "x" * 10**6, "<![CDATA[" * 100_000, "<!" * 500_000,
                                  "<div>" * 100_000 + "</p>" * 100_000, '<a x="' * 100_000 + ">", "<" * 10**6])
def test_broken_pages_take_linear_time(page):
    import time

    from boxtally.llm import html_main

    start = time.time()
    html_main.Page(page)
    assert time.time() - start < 15


def test_marks_of_a_page():
    from boxtally.llm import html_main

    found = [(m[2], m[3], m[4], m[5]) if len(m) > 5 else m[2:] for m in html_main._tags(
        "a<b x='>'>c<!-- <i> --></B >d<![CDATA[e<f>]]><!doctype g><1><a \"")]
    assert found == [(None, False, "b", " x='>'"), (None, False, "", ""), (None, True, "B", " "), ("e<f>", False, "", ""), (None, False, "", "")]


def test_numerals_are_no_letters():
    from boxtally.llm import language

    model = language.Model(["en"], [Counter({"word": 3})])
    assert language.Scorer(model)("² ½ ① 12 !")[0] == "und" and language.Scorer(model)("x² ½")[0] == "en"


def test_many_hits_in_one_text(spark):
    """Twenty thousand words, each a hit of a one-word item: the text is parted once, not once per hit."""
    import time

    from boxtally.llm import decontam

    docs = spark.createDataFrame([(1, "the " * 20_000), (2, "a the b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the the the")], "item_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[2].n_hit, rows[2].n_items) == (20_000, 2, 1, 1)
    assert time.time() - start < 60


def test_decontamination_equals_brute_force(spark):
    from boxtally.llm import decontam

    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", "f", "g"] + [f"w{i}" for i in range(20)]
    docs = [(i, " ".join(rng.choice(words[:rng.choice([3, 7, 27])]) for _ in range(rng.randrange(0, 80)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(words[:rng.choice([3, 7, 27])]) for _ in range(rng.choice([1, 2, 3, 5, 13, 14, 20])))) for i in range(22)]
    docs = [(i, f"{t} {items[i % 22][1]} x") if i % 7 == 0 else (i, t) for i, t in docs]
    want = set()
    for doc_id, text in docs:
        own, hit, seen = text.split(), set(), set()
        for item_id, item in items:
            item = item.split()
            n = min(13, len(item))
            grams = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)}
            for k in range(len(own) - n + 1):
                if tuple(own[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    seen.add(item_id)
        want.add((doc_id, len(own), len(hit), len(seen)))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()} == want


def test_folded_totals(spark):
    from boxtally.llm import token_counts
    from boxtally.session import scratch_path

    versions = {"w": lambda: lambda t: len(t.split())}
    rollup = token_counts.Rollup(spark, scratch_path(spark, "fold"))

    def add(batch, rows, sign=token_counts.inserted):
        return rollup.commit(batch, sign(spark.createDataFrame(rows, "text string, source string, lang string")), versions)

    def now():
        return sorted((r.source, r.docs, r.tokens) for r in rollup.totals().collect())

    rollup.fold()
    assert now() == []
    add("a", [("x y", "s", "l"), ("z", "t", "l")])
    rollup.fold()
    assert now() == [("s", 1, 2), ("t", 1, 1)] and len(rollup._parts()[2]) == 1
    add("b", [("x y", "s", "l")], token_counts.deleted)
    assert not add("a", [("again", "s", "l")]) and now() == [("s", 0, 0), ("t", 1, 1)]
    rollup.fold()
    rollup.fold()
    assert now() == [("s", 0, 0), ("t", 1, 1)] and rollup.batches() == ["a", "b"] and len(rollup._parts()[2]) == 1
    # a fold that died before its totals were whole does not count
    spark.createDataFrame([("lost",)], "batch string").write.parquet(f"{rollup.root}/folded=9/ids")
    assert now() == [("s", 0, 0), ("t", 1, 1)]
