from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxtally.llm import (attention_lm, boosting, decontam, exact_dedup, html_main, language, mixing, near_dedup, quality,
                          sharding, token_counts)
from boxtally.llm.common import count_space_words, table
from boxtally.llm.queries import QUERIES, SQL
from boxtally.session import scratch_path
from oracle_check import connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 3000
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 3), (4, "One two three four five six", "en", "b", 27),
       (4, "One two three four five six", "en", "b", 27), (None, "one TWO three four five six", "en", "b", 27),
       (5, LONG, None, None, len(LONG)), (6, "Ü ü é", "de", "a", 5), (7, "123 456 !!", "en", "a", 10)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns whose names operators use."""
    return spark.createDataFrame(ODD, DOCS).withColumns(
        {c: F.lit("x") for c in ("size", "kept", "word", "score", "term", "shard", "taken", "id", "row", "bin", "weight")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got = [tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES[name](spark, sf_dir).collect()]
    cur = connect(sf_dir).execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = [tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()]
    assert sorted(got) == sorted(want)


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (1, "one two three four five six"),
                                   (None, "ü"), (10, "FIVE, six")], "item_id long, text string")
    rows = decontam.contamination(odd, bench).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[4, 6].n_hit == 6 and by[4, 6].n_items == 2 and by[4, 6].contaminated
    assert by[4, 6].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert by[None, 6].n_items == 2 and by[6, 3].n_hit == 1 and by[6, 3].n_items == 0
    assert not by[1, 0].contaminated and by[5, 12000].n_hit == 0
    assert decontam.contamination(none, bench).count() == 0
    assert not decontam.contamination(odd, bench.limit(0)).where("contaminated").count()
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "red a b c d e f green blue"), (3, "blue green")], "doc_id long, text string")
    queries = spark.createDataFrame([(9, ["red", "green", "blue"])], "query_id long, words array<string>")
    index = decontam.build_index(docs)
    assert {r.doc_id for r in decontam.near_matches(index, queries, 2).collect()} == {1}


def _near_brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize(("short_list", "heads"), [(8, 3), (1, 3), (1, 0)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, short_list, heads):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short_list)
    monkeypatch.setattr(near_dedup, "HEADS", heads)  # without heads the deltas find all links
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one"), (904, "w1 w2")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == _near_brute(rows, 2, 80)


def test_pairs_by_chance_are_dropped_by_bits(spark):
    """Bits drop no pair that agrees in MATCHES coordinates, and nearly all that agree in one."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        a = rng.integers(-2**31, 2**31, near_dedup.COORDINATES)
        b = rng.integers(-2**31, 2**31, near_dedup.COORDINATES)
        same = rng.permutation(near_dedup.COORDINATES)[:near_dedup.MATCHES if k % 2 else 1]
        b[same] = a[same]
        rows.append((k % 2 == 1, a.tolist(), b.tolist()))
    pairs = spark.createDataFrame(rows, "similar boolean, a array<int>, b array<int>")
    for c in "ab":
        pairs = pairs.withColumn("signature", F.col(c)).withColumns({f"{c}_low": near_dedup._bits(0), f"{c}_high": near_dedup._bits(1)})
    met = Counter(r.similar for r in pairs.where(near_dedup._may_agree("a_", "b_")).collect())
    assert met[True] == 200 and met[False] <= 1


def test_near_dedup_odd_rows(odd, none):
    rows = near_dedup.near_components(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == 2} == {(4, 4, True), (None, 4, False)}
    assert near_dedup.near_components(none).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_near_dedup_misses_fewer_than_one_in_a_million():
    tail = sum(math.comb(near_dedup.COORDINATES, k) * 0.8**k * 0.2 ** (near_dedup.COORDINATES - k) for k in range(near_dedup.MATCHES))
    assert tail < 1e-6


def test_lm_probabilities_sum_to_one_and_gradient():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1000, 4000)
    cls = attention_lm.Classes(np.bincount(ids, minlength=attention_lm.IDS))
    pairs = rng.integers(0, 5, (attention_lm.CLASSES + 1, attention_lm.CLASSES)).astype(float)
    prior = attention_lm.Prior(pairs)
    w = attention_lm.start_weights()
    w = {n: v + rng.standard_normal(v.shape).astype(np.float32) * 0.05 for n, v in w.items()}
    s = attention_lm.Scorer(w, prior)
    y = rng.standard_normal((attention_lm.CLASSES, attention_lm.WIDTH)).astype(np.float32)
    logs = s.log_probs(np.repeat(y[:1], attention_lm.CLASSES, axis=0), np.full(attention_lm.CLASSES, 3), np.arange(attention_lm.CLASSES))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    assert np.exp(cls.log_share[cls.of == attention_lm.CLASSES - 1]).sum() == pytest.approx(1, abs=1e-3)
    x, t, scored = attention_lm.windows(cls.of[ids[:100]])
    assert scored.sum() == 100

    def loss(v):
        sc = attention_lm.Scorer(v, prior)
        return -sc.log_probs(sc.hidden(x, scored), x[scored], t[scored]).mean()

    g = attention_lm.gradients(w, prior, x, t, scored)
    for name in ("q", "v", "w1", "ug", "um", "emb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[name][at] += 0.02
        down[name][at] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(float(g[name][at]), rel=0.15, abs=2e-4)


def test_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in attention_lm.score(docs).collect()}
    texts = {r.doc_id: (r.text or "").translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t.split())
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, t in texts.items():
        ws = t.split()
        base = sum(np.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [c[w] for w in ws] + [ends])
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws) + 1, n)
        assert r.n_known == sum(w in c for w in ws) + 1 and r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    out = [r for r in rows.values() if r.held_out]
    # The base gives every unseen word the same share, so it does not sum to one and no bound on the tiny tables.
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > -4.6


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    """Documents with a word of their own: the embedding of each moves only if its document reached a gradient."""
    monkeypatch.setattr(attention_lm, "TASK_DOCS", 40)
    monkeypatch.setattr(attention_lm, "WARM_DOCS", 20)
    docs = spark.createDataFrame([(i, " ".join([chr(97 + i // 26) + chr(97 + i % 26)] * 5)) for i in range(500)],
                                 "doc_id long, text string")
    cls = attention_lm.Classes(attention_lm.id_counts(attention_lm.word_counts(docs), token_counts.TOKENIZERS))
    rounds, width = attention_lm.rounds_of(500)
    assert rounds > 2 and width > 2
    encoded = attention_lm.write_classes(docs, cls, rounds)
    rows = encoded.collect()
    assert len(rows) == 500 and {r["round"] for r in rows} == set(range(rounds))
    prior = attention_lm.Prior(np.zeros((attention_lm.CLASSES + 1, attention_lm.CLASSES)))
    moved = np.abs(attention_lm.fit(encoded, prior, rounds, width)["emb"] - attention_lm.start_weights()["emb"]).max(axis=1)
    used = {int(c) for r in rows for c in np.frombuffer(r["classes"], np.int16)[:-1]}
    assert len(used) > 250 and all(moved[c] > 0 for c in used)
    # The steps that follow one another grow with the corpus.
    n = [attention_lm.rounds_of(k)[0] for k in (50_000, 500_000, 5_000_000)]
    assert n[0] < n[1] < n[2]


def test_lm_prior_counts_the_order_of_words(spark):
    """Two words of equal count that only ever follow one another in one order."""
    docs = spark.createDataFrame([(i, "up down up down") for i in range(50)] + [(99, None)], "doc_id long, text string")
    cls = attention_lm.Classes(attention_lm.id_counts(attention_lm.word_counts(docs), token_counts.TOKENIZERS))
    up, down = (int(cls.of[attention_lm.Encoder(token_counts.TOKENIZERS).ids([w])[0]]) for w in ("up", "down"))
    prior = attention_lm.fit_prior(attention_lm.write_classes(docs, cls, 1))

    def log(after, to):
        g, m = divmod(to, attention_lm.MEMBERS)
        return prior.group[after, g] + prior.member[g][after, m]

    assert log(up, down) > np.log(0.8) and log(up, up) < np.log(0.1)
    assert log(attention_lm.CLASSES, up) > np.log(0.8) and log(attention_lm.CLASSES, down) < np.log(0.1)


def test_lm_windows_of_training_do_not_overlap():
    """Each id is the target of one window, and windows hold few places that are not learned from."""
    ids = np.arange(10 * attention_lm.WINDOW + 3) % attention_lm.CLASSES
    x, target, scored = attention_lm.windows(ids, attention_lm.WINDOW)
    assert np.array_equal(target[scored], ids) and x[0, 0] == attention_lm.CLASSES
    assert np.array_equal(x[scored][1:], ids[:-1]) and scored[:-1].all()


def test_lm_batches_score_as_one_window_at_a_time():
    rng = np.random.default_rng(1)
    prior = attention_lm.Prior(rng.integers(0, 5, (attention_lm.CLASSES + 1, attention_lm.CLASSES)).astype(float))
    w = {n: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for n, v in attention_lm.start_weights().items()}
    scorer = attention_lm.Scorer(w, prior)
    texts = [rng.integers(0, attention_lm.CLASSES, n).astype(np.int16) for n in (1, 63, 64, 65, 700, 3)]
    got = attention_lm.score_classes(scorer, texts, 4)
    for text, total in zip(texts, got):
        one = 0.0
        for x, target, scored in zip(*attention_lm.windows(text)):
            for at in np.flatnonzero(scored):
                # Nothing behind a place is seen from it.
                cut = np.where(np.arange(len(x)) <= at, x, 0)[None]
                only = (np.arange(len(x)) == at)[None]
                one += scorer.log_probs(scorer.hidden(cut, only), x[at:at + 1], target[at:at + 1])[0]
        assert total == pytest.approx(one, rel=1e-4)


def test_lm_encodes_whole_batches_as_word_by_word(spark):
    texts = [" Abc  def\u00a0 x\u2003y\t'S ", None, "", "a\u00a0 \u00a0b", "ÄB\x0bc\x1c12,;d e" * 3, "zwölf 12 Abc's", "\u3000"]
    enc = attention_lm.Encoder(token_counts.TOKENIZERS)
    cls = attention_lm.Classes(np.arange(attention_lm.IDS)[::-1])
    head = attention_lm.Head(pa.array(["abc", "e", "never"]), np.array([5.0, 3, 1]), enc)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = attention_lm.write_classes(docs, cls, 1, head=head).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lowered = (texts[r.doc_id] or "").translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))}))
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        ids = [i for w in words for i in enc.enc.encode_ordinary(" " + w)] + [attention_lm.END]
        assert np.frombuffer(r.classes, np.int16).tolist() == cls.of[ids].tolist()
        assert r.n_tokens == len(words) + 1 and r.known == sum(w in ("abc", "e") for w in words)
        assert sorted(r.tail) == sorted(w for w in words if w not in ("abc", "e"))
        assert r.rest == pytest.approx(float(cls.log_share[ids].sum()), rel=1e-5)


def test_lm_odd_rows(odd, none):
    rows = attention_lm.score(odd).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert attention_lm.score(none).count() == 0


def test_quality_on_held_out_rows(spark, sf_dir):
    rows = {r.doc_id: r for r in quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    out = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert np.mean([p == q for p, q in out]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())


def test_quality_hashes_whole_words():
    same = "x" * 16
    hashes = {quality.Vectors()._word(w) for w in (same, same + "a", same + "b", "x" * 64 + "a", "x" * 64 + "b")}
    assert len(hashes) == 5


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0
    assert quality.drop_low_quality(odd, labels).columns == odd.columns
    scored = {r.doc_id: r.predicted for r in quality.score_quality(odd, labels).collect()}
    left = quality.drop_low_quality(odd, labels).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(r[0]) for r in ODD if scored[r[0]] == 1)


def test_language(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[6].lang_pred in ("de", "en")
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(none).count() == 0


@pytest.mark.parametrize("parts", [4, 4096])
def test_language_sample_is_the_smallest_draws(spark, sf_dir, parts):
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    draws: dict[str, list] = {}
    for r in docs.select("lang", "doc_id", F.xxhash64("doc_id", F.length("text")).alias("draw")).collect():
        draws.setdefault(r.lang, []).append((r.draw, r.doc_id))
    want = {(x, doc_id) for x, all_ in draws.items() for _, doc_id in sorted(all_)[:20]}
    got = language.sample_ids(docs, 20, parts).collect()
    assert {(r.lang2, r.id2) for r in got} == want and len(got) == len(want)


def test_token_rollup(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    first, gone = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 4 = 0")
    new = gone.withColumn("text", F.concat(F.col("text"), F.lit(" more")))
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", token_counts.inserted(first)) and rollup.commit("b2", token_counts.inserted(docs.where("doc_id % 2 = 1")))
    assert not rollup.commit("b1", token_counts.inserted(first))
    assert rollup.commit("b3", token_counts.revised(gone, new)) and rollup.commit("b4", token_counts.deleted(docs.where("doc_id % 2 = 1")))
    enc = token_counts.rank_encoder(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")
    want: dict = {}
    for r in docs.where("doc_id % 2 = 0").collect():
        t = r.text + " more" if r.doc_id % 4 == 0 else r.text
        for name, n in (("words-1", len(t.split())), ("byte-bpe-50k", len(enc.encode_ordinary(t)))):
            k = want.setdefault((r.source, r.lang, name), [0, 0, 0])
            k[0], k[1], k[2] = k[0] + 1, k[1] + n, k[2] + len(t)
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.chars] for r in rollup.totals().collect()}
    assert {k: v for k, v in got.items() if v != [0, 0, 0]} == want
    assert token_counts.deltas(token_counts.inserted(odd)).agg(F.sum("docs")).first()[0] == 2 * len(ODD)


def test_token_query_runs_all_kinds_of_deltas(spark, sf_dir, monkeypatch):
    made = []
    plain = token_counts.Rollup.commit
    monkeypatch.setattr(token_counts.Rollup, "commit", lambda self, *a: made.append((a[0], plain(self, *a), self)) or made[-1][1])
    got = {tuple(r) for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    assert got == {tuple(r) for r in token_counts.deltas(token_counts.inserted(table(spark, sf_dir, "documents"))).collect()}
    assert [b for b, fresh, _ in made if not fresh] == ["load-1"] and len(made) == 8
    signs = spark.read.parquet(f"{made[0][2].root}/batch=delete-1").agg(F.max("docs")).first()[0]
    assert signs < 0


PAGES = [
    ('<html><body><nav><a href="/">Home</a></nav><div class="content"><h2>Title</h2><p>Long text here, with words. And\n more of '
     'it.</p><p>Another &amp; text &eacute;</p><aside>side</aside></div><div class="comments"><p>nice</p></div></body></html>',
     "Title\n\nLong text here, with words. And more of it.\n\nAnother & text é"),
    ("no tags at all", "no tags at all"), ("", ""), (None, ""), ("<p>a<p>b<script>x</script><p>c", "a\n\nb\n\nc"),
    ('<article><p>One<br>two</p></article><footer>foot</footer><div class="cookie-notice">We use cookies</div>', "One two")]


def test_html_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    model = html_main.fit(pages)
    odd = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_main.extract(odd, model).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_main.extract_main(odd.limit(0)).count() == 0
    full = QUERIES["op7_html_text"](spark, sf_dir)
    assert full.count() == pages.count() and full.where("text like '%©%' or text = ''").count() == 0


def test_html_deep_page_and_decoding():
    page = html_main.Page("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert page.blocks(np.ones(len(page.tag), bool)) == ["deep"]
    page = html_main.Page("<div><p>a</p><p>b</p></div>")
    keep = html_main.decode(page, np.array([5.0, -1.0, 3.0, 3.0]))
    assert keep.tolist() == [True] * 4
    assert html_main.decode(page, np.array([5.0, -9.0, 3.0, 3.0])).tolist() == [True, False, False, False]


def test_boosting_learns_a_step():
    x = np.random.default_rng(1).random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((boosting.Boosted().fit(x, y).predict(x) > 0) == (y > 0)).mean() > 0.97


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(2)
    for _ in range(40):
        t = [rng.choice([0.0, 1.0, 2.5, 7.0, 7.0, 30.0]) for _ in range(rng.randint(1, 6))]
        seats, most = rng.randint(0, 50), [rng.randint(0, 30) for _ in t]
        want = [0] * len(t)
        for _ in range(seats):
            open_ = [i for i in range(len(t)) if t[i] > 0 and want[i] < most[i]]
            if open_:
                want[max(open_, key=lambda i: (t[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(t, seats, most) == want


def test_mixing(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in rows) and len(rows) == len(size)
    for s in set(source.values()):
        mine = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * mixing.BLOCK_TOKENS
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert sum(mixing.targets([10, 0, 1000, 5])) == pytest.approx(1015) and mixing.targets([10, 1000])[0] == 30
    mixed = mixing.mixed_documents(docs).withColumn("n", count_space_words(F.col("text")))
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_shards_hold_their_quotas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mixed_shards(docs).collect()
    assert {(r.source, r.block, r["pass"]): r.shard for r in rows}.keys() == {(r.source, r.block, r["pass"]) for r in rows}
    blocks = {(r.source, r.block, r["pass"], r.shard) for r in rows}
    assert len(blocks) == len({b[:3] for b in blocks})
    got = Counter((b[0], b[3]) for b in blocks)
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
    names = sorted(words)
    want = {(s, k): n for s, p in zip(names, mixing.plan([words[s] for s in names])) for k, n in enumerate(p["per_shard"]) if n}
    assert got == want
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.taken
    assert taken == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}


def test_exact_dedup(spark, odd, tmp_path):
    path = str(tmp_path / "docs.parquet")
    odd.repartition(3).write.parquet(path)
    rows = exact_dedup.exact_groups(spark, path).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = Counter(norm(t) for _, t, *_ in ODD)
    keep = {k: max((i for i, t, *_ in ODD if norm(t) == k and i is not None), default=None) for k in groups}
    want = sorted((str(i), str(keep[norm(t)]), groups[norm(t)], i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest())
                  for i, t, *_ in ODD)
    flat = lambda rs: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rs)
    assert flat(rows) == want
    # A digest that many texts share is told apart by the bytes.
    assert flat(exact_dedup.exact_groups(spark, path, lambda t: (F.length(t) % 3).cast("string")).collect()) == want
    # Later files meet the state of earlier ones.
    mark = scratch_path(spark, "again")
    exact_dedup.digest_state(spark, path, checkpoint=mark).collect()
    spark.createDataFrame([(99, "ONE two three four five six", None, None, 0)], DOCS).write.mode("append").parquet(path)
    state = exact_dedup.digest_state(spark, path, checkpoint=mark)
    assert state.where("keep_id = 99").first().group_size == 4 and state.agg(F.sum("group_size")).first()[0] == len(ODD) + 1
    empty = str(tmp_path / "none.parquet")
    odd.limit(0).write.parquet(empty)
    assert exact_dedup.exact_groups(spark, empty).count() == 0


def test_exact_dedup_reads_files_that_look_old(spark, tmp_path):
    path, mark = str(tmp_path / "aged.parquet"), scratch_path(spark, "aged")
    one = spark.createDataFrame([(1, "Same", None, None, 0)], DOCS).coalesce(1)
    one.write.parquet(path)
    exact_dedup.digest_state(spark, path, checkpoint=mark).collect()
    before = set(os.listdir(path))
    one.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - before:
        os.utime(f"{path}/{name}", (time.time() - 30 * 86400,) * 2)
    assert exact_dedup.digest_state(spark, path, checkpoint=mark).first().group_size == 2


def test_sharding(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    rows = sharding.shard(docs).collect()
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert set(sums) == set(range(16)) and len(rows) == len(text)
    assert max(sums.values()) - min(sums.values()) <= 2 * max(map(len, text.values()))
    for s in sums:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    same = spark.createDataFrame([(1, "same text", "en", "a", 9)] * 500 + [(i, "same text", "en", "a", 9) for i in range(500)], DOCS)
    assert max(Counter(r.shard for r in sharding.shard(same).where("doc_id <> 1").collect()).values()) < 80
    assert sharding.shard(odd, 3).count() == len(ODD) and sharding.shard(none).count() == 0


def test_sharding_by_target_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    for target in (total // 5, 2 * total):
        rows = sharding.shard(docs, target_bytes=target).collect()
        assert {r.shard for r in rows} == set(range(max(1, -(-total // target))))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    before, rows = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        assert rows.dtypes == docs.dtypes and 0 < rows.count()
        if name == "decontamination":
            assert rows.count() < before and rows.distinct().count() == rows.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert placed.count() == rows.count() == corpus_pipeline.run(spark, sf_dir).count()


def test_sharding_plan_grows_with_levels_alone(spark, sf_dir):
    """Four times the shards are two levels more, and no condition per shard in the plan."""
    rows = sharding.narrow(table(spark, sf_dir, "documents")).withColumn("weight", F.col("size"))

    def plan(leaves):
        tree = sharding.kd_tree(rows, ["by_id", "size", "by_source", "by_lang"], leaves)
        return tree, len(tree.groupBy("node").count()._jdf.queryExecution().optimizedPlan().toString())

    few, many = plan(4), plan(16)
    assert many[1] < 3 * few[1]
    assert {r.node for r in many[0].select("node").distinct().collect()} == set(range(16))
