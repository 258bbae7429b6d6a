"""Every operator against a plain version: odd rows, empty tables, clashing columns, the smallest given tables."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


# --- repeated substrings -------------------------------------------------------------------------


def expected_repeats(docs, window, words):
    out = []
    for (d, _), (units, flags) in zip(docs, brute.repeats(docs, window, words)):
        kept = [u for u, f in zip(units, flags) if not f]
        out.append((d, len(units), sum(flags), brute.runs(flags), b" ".join(kept) if words else bytes(kept)))
    return Counter(out)


def found_repeats(df):
    return Counter(
        (r.doc_id, r.n_units, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()
    )


@pytest.mark.parametrize("words,window", [(True, 13), (True, 3), (False, 50), (False, 7)])
def test_repeats_of_odd_rows(texts, odd_rows, words, window):
    from tideline.llm.substrings import substring_dedup
    from tideline.llm.suffixes import suffix_dedup

    rows = [(d, t[:3000] if t else t) for d, t in odd_rows]
    docs = texts(rows, extra=True)
    found = (substring_dedup if words else suffix_dedup)(docs, window)
    assert found_repeats(found) == expected_repeats(rows, window, words)


@needs_tables
@pytest.mark.parametrize("words,window", [(True, 13), (False, 50)])
def test_repeats_of_given_tables_in_many_blocks(spark, monkeypatch, words, window):
    from tideline.llm import blocks, repeats, substrings, suffixes

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(repeats, "STEP_BYTES", 10_000)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    monkeypatch.setattr(suffixes, "BATCH", 500)
    docs = given(spark)
    found = (substrings.substring_dedup if words else suffixes.suffix_dedup)(docs, window)
    assert found_repeats(found) == expected_repeats(pairs_of(docs), window, words)


@pytest.mark.parametrize("words,window", [(True, 13), (False, 50)])
def test_a_passage_of_a_third_of_all_documents(spark, texts, monkeypatch, words, window):
    """Windows around the passage have its anchors and differ in every document; they spread over the buckets."""
    import random

    from tideline.llm import blocks, repeats, substrings, suffixes

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(repeats, "HOT_DOCUMENTS", 64)
    draw = random.Random(window)
    passage = " ".join(f"shared{i}" for i in range(20))
    rows = []
    for d in range(10_000):
        own = [f"{draw.randrange(10**6):x}" for _ in range(16)]
        rows.append((d, " ".join([*own[:8], passage, *own[8:]]) if d % 3 == 0 else " ".join(own)))
    docs = texts(rows)
    found = (substrings.substring_dedup if words else suffixes.suffix_dedup)(docs, window)
    assert found_repeats(found) == expected_repeats(rows, window, words)
    # What the buckets get, in bytes of text.
    count = blocks.block_count(docs)
    units = substrings.word_units(window) if words else suffixes.byte_units(window)
    sizes = sorted(pieces_per_bucket(blocks.in_blocks(docs, count), units, count))
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def pieces_per_bucket(held, units, buckets):
    """Bytes of pieces that reach each bucket."""
    import pyarrow as pa

    from tideline.llm import repeats
    from tideline.llm.blocks import expand

    def size(table: pa.Table) -> pa.Table:
        n = sum(len(expand(x)) for x in table.column("contents").to_pylist() if x is not None)
        return pa.table({"n": pa.array([n], pa.int64())})

    pieces = repeats.pieces_of(held, units, buckets)
    return [r.n for r in pieces.groupBy("bucket").applyInArrow(size, "n bigint").collect()]


def test_cut_repeats_keeps_columns_and_characters(texts, odd_rows):
    from tideline.llm.suffixes import cut_repeats

    rows = [(d, t[:3000] if t else t) for d, t in odd_rows]
    docs = texts(rows, extra=True)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    cut = cut_repeats(docs)
    assert cut.columns == docs.columns
    assert cut.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    found = cut.collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    assert all(r["a.b"] == "x" and r.block == "x" for r in found)
    by_id = {r.doc_id: r.text for r in found}
    assert by_id[10] == dict(rows)[10]
    assert "shared20" not in by_id[11] and by_id[11].startswith("other words") and by_id[11].endswith("an end")


@pytest.mark.parametrize("size", [1, 2, 3, 6, 13, 24])
def test_gram_hashes_tell_grams_apart(size):
    from tideline.llm.blocks import mixed
    from tideline.llm.repeats import gram_hashes

    values = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    hashes = gram_hashes(mixed(values + np.uint64(1)), size)
    grams = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(hashes) == len(grams)
    assert len(set(zip(hashes.tolist(), grams))) == len(set(grams)) == len(set(hashes.tolist()))


def test_suffix_automaton_holds_all_runs():
    from tideline.llm.automaton import SuffixAutomaton

    random = np.random.default_rng(2)
    texts = ["".join(random.choice(list("ab"), 12)) for _ in range(6)]
    automaton = SuffixAutomaton()
    for owner in (3, 0, 5, 1, 4, 2):
        automaton.add(texts[owner], owner)
    automaton.settle()
    for query in ["".join(random.choice(list("abc"), 30)) for _ in range(20)]:
        for end, (state, run) in enumerate(automaton.matches(query)):
            longest = max(n for n in range(end + 2) if any(query[end + 1 - n : end + 1] in t for t in texts))
            assert run == longest
            if run:
                while automaton.length[automaton.link[state]] >= run:
                    state = automaton.link[state]
                found = query[end + 1 - run : end + 1]
                assert automaton.first[state] == min(i for i, t in enumerate(texts) if found in t)


# --- near-duplicates -----------------------------------------------------------------------------


def near_rows():
    """Copies, near copies just above and below the bound, a chain of links, and documents in a shared band only."""
    random = np.random.default_rng(3)
    base = [f"t{i}" for i in random.integers(0, 5000, 203)]
    rows = [(100, " ".join(base)), (99, " ".join(base)), (98, "  ".join(base).upper())]
    for k in range(1, 30):
        changed = list(base)
        changed[10 + 5 * (k % 6) : 10 + 5 * (k % 6) + k] = [f"n{k}_{i}" for i in range(k)]
        rows.append((100 + k, " ".join(changed)))
    chain = [f"c{i}" for i in range(260)]
    rows += [(200 + k, " ".join(chain[10 * k : 10 * k + 150])) for k in range(10)]
    rows += [(300, ""), (301, None), (302, " \n"), (303, "two words"), (304, "Two  WORDS"), (305, "two")]
    return rows


def found_near(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates_match_all_pairs(texts, monkeypatch, chunk):
    from tideline.llm import near

    monkeypatch.setattr(near, "CHUNK", chunk)
    rows = near_rows()
    expected = {d: (n, c, d == c) for (d, _), (n, c) in zip(rows, brute.near_components(rows))}
    assert found_near(near.near_duplicates(texts(rows, extra=True))) == expected


@needs_tables
def test_near_duplicates_of_given_tables(spark):
    from tideline.llm.near import near_duplicates

    docs = given(spark)
    rows = pairs_of(docs)
    expected = {d: (n, c, d == c) for (d, _), (n, c) in zip(rows, brute.near_components(rows))}
    assert found_near(near_duplicates(docs)) == expected


def test_a_long_chain_of_links_takes_few_rounds(spark, monkeypatch):
    import random

    from tideline.llm import near
    from tideline.operators import components

    ids = list(range(1_000))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5_000, 5_001), (5_001, 5_000)], "a bigint, b bigint")
    rounds = []
    cut = components.Rounds.cut
    monkeypatch.setattr(components.Rounds, "cut", lambda self, state: rounds.append(1) or cut(self, state))
    found = {r.doc_id: r.component for r in near.components(links).collect()}
    assert found == {i: 0 for i in range(1_000)} | {5_000: 5_000, 5_001: 5_000}
    assert len(rounds) <= 15


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_other_similarities(texts, percent):
    from tideline.llm import near

    rows = near_rows()
    expected = {d: (n, c, d == c) for (d, _), (n, c) in zip(rows, brute.near_components(rows, percent=percent))}
    assert found_near(near.near_duplicates(texts(rows), percent=percent)) == expected


def test_similarities_that_sketches_may_miss_are_refused(texts):
    from tideline.llm import near

    with pytest.raises(ValueError):
        near.near_duplicates(texts(near_rows()), percent=79)


def test_steps_leave_the_shared_folder(texts, spark):
    import os

    from tideline.llm import near
    from tideline.session import shared_folder

    near.near_duplicates(texts(near_rows())).collect()
    left = os.listdir(shared_folder(spark).removeprefix("file:"))
    assert not [f for f in left if f.split("-")[0] in ("bands", "stars", "links", "joins", "clusters")]


def test_near_duplicates_of_odd_rows(texts, odd_rows):
    from tideline.llm.near import keep_one_of_each, near_duplicates

    docs = texts(odd_rows, extra=True)
    found = near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in odd_rows)
    # The shared passage makes up nearly all of four texts.
    assert {r.component_id for r in found if r.doc_id in (10, 11, 12, None)} == {10}
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in odd_rows if d not in (11, 12, None))


def test_sketches_fill_and_concentrate():
    from tideline.llm.near import SLOTS, sketch

    random = np.random.default_rng(4)
    elements = random.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert np.array_equal(sketch(elements), sketch(np.sort(elements)))
    assert len(sketch(elements[:1])) == SLOTS
    agreed = [(sketch(elements[k:]) == sketch(elements[: len(elements) - k])).mean() for k in (0, 50, 111, 333)]
    assert agreed[0] == 1
    for share, k in zip(agreed[1:], (50, 111, 333)):
        assert abs(share - (1000 - 2 * k) / 1000) < 0.2


# --- scoring -------------------------------------------------------------------------------------


def scored_base(rows):
    return Counter(
        (d, *w[:4], round(w[4], 6)) for (d, _), w in zip(rows, brute.base_scores(rows))
    )


@needs_tables
def test_lm_scores_of_given_tables(spark, monkeypatch):
    from tideline.llm import pitman_yor

    docs = given(spark)
    rows = pairs_of(docs)
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 200_000)
    found = pitman_yor.lm_scores(docs).collect()
    assert Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    ) == scored_base(rows)
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    again = {r.doc_id: r.score for r in pitman_yor.lm_scores(docs.orderBy(F.desc("doc_id")).repartition(5)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in found)


def test_lm_scores_of_odd_rows(texts, odd_rows):
    from tideline.llm.pitman_yor import lm_scores

    found = lm_scores(texts(odd_rows, extra=True)).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in odd_rows)
    rows = [(d, t) for d, t in odd_rows if d is not None]
    found = lm_scores(texts(rows)).collect()
    assert Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    ) == scored_base(rows)
    assert all(r.score <= 0 for r in found)


def one_bucket(counts):
    """A bucket's restaurants with ``counts`` customers per context and word, all numbered from 1."""
    import pyarrow as pa

    from tideline.llm import pitman_yor as py
    from tideline.llm.blocks import pack_sorted, squeeze

    contexts, words = (np.arange(1, n + 1, dtype=np.uint64) for n in counts.shape)
    row = {
        "bucket": 0,
        "block": 0,
        "contexts": pack_sorted(contexts),
        "fans": squeeze(np.full(len(contexts), len(words), np.uint32)),
        "words": np.tile(words, len(contexts)).tobytes(),
        "counts": squeeze(counts.astype(np.uint32)),
    }
    return py._Restaurants(pa.Table.from_pylist([row], schema=py._ASKED), py.PitmanYor())


def root_of(own):
    """The root after one table per dish and context."""
    import pyarrow as pa

    from tideline.llm import pitman_yor as py
    from tideline.llm.blocks import squeeze

    fans = own.fans().astype(np.uint32)
    seats = (fans > 0).astype(np.uint32)
    row = {"bucket": 0, "shard": 0, "given": squeeze(fans), "held": squeeze(fans), "seats": squeeze(seats), "tokens": 0}
    row |= {"dishes": int(seats.sum()), "customers": int(fans.sum()), "root_tables": int(seats.sum())}
    return py._Root(pa.Table.from_pylist([row], schema=py._ROOT), own.model)


def test_predictive_probabilities_sum_to_one():
    """Over all known words and the one unknown word, after every context and at the root, in every sweep."""
    counts = np.random.default_rng(9).integers(0, 30, (5, 8))
    counts[0] = 0
    own = one_bucket(counts)
    root, model, drawn = root_of(own), own.model, own.alone()
    for sweep in range(4):
        random = own.random(sweep)
        parent = root.probabilities()
        unknown = (model.root_strength + model.root_discount * root.tables) / (root.dishes + 1) / (model.root_strength + root.customers)
        assert parent.sum() + unknown == pytest.approx(1.0)
        drawn = own.seated(parent, drawn, random)
        assert (drawn <= own.counts).all() and ((drawn > 0) == (own.counts > 0)).all()
        weight = model.strength + model.discount * own.per_context(drawn)
        known = own.per_context(own.counts - model.discount * drawn + weight[own.context] * parent[own.word])
        assert (known + weight * unknown) / (model.strength + own.customers) == pytest.approx(1.0)
        root.take(np.bincount(own.word, drawn, len(own.words)), random)
        assert root.customers == drawn.sum() and (root.seats <= root.held).all() and root.tables == root.seats.sum()


def seat_one_by_one(customers, others, parent, strength, discount, random, repeats):
    tables = np.ones(repeats)
    for k in range(1, customers):
        mass = (strength + discount * (others + tables)) * parent
        tables += random.random(repeats) * (mass + k - discount * tables) < mass
    return tables


@pytest.mark.parametrize("others,parent,discount", [(0, 0.5, 0.0), (5, 0.3, 0.8), (40, 0.01, 0.5), (0, 0.9, 0.8)])
def test_drawn_tables_follow_the_seating(monkeypatch, others, parent, discount):
    """The mean number of tables against a seating of single customers, in runs of customers and table by table."""
    from tideline.llm import pitman_yor as py

    random, n = np.random.default_rng(5), 2_000
    for customers in (1, 2, 40, 200, 1500):
        plain = seat_one_by_one(customers, others, parent, 1.0, discount, random, n)
        for per_table in (0, 1 << 40):
            monkeypatch.setattr(py, "RUN_PER_TABLE", per_table)
            monkeypatch.setattr(py, "FEW_TABLES", 0)
            drawn = py.draw_tables(np.full(n, customers), np.full(n, float(others)), np.full(n, parent), 1.0, discount, random)
            assert drawn.min() >= 1 and drawn.max() <= customers
            error = 4 * np.hypot(plain.std(), drawn.std()) / n**0.5
            assert abs(drawn.mean() - plain.mean()) <= error + 1e-9


def test_sweeps_keep_the_mean_of_a_single_dish():
    """A dish of 200 customers beside five others with one customer each: about 24.6 tables in every sweep."""
    from tideline.llm import pitman_yor as py

    contexts = 400
    counts = np.ones((contexts, 6), np.int64)
    counts[:, 0] = 200
    own = one_bucket(counts)
    parent = np.full(6, 0.14)
    parent[0] = 0.3
    random = np.random.default_rng(2)
    plain = seat_one_by_one(200, 5, 0.3, 1.0, own.model.discount, random, 20_000)
    drawn = own.alone()
    for sweep in range(12):
        drawn = own.seated(parent, drawn, own.random(sweep))
        mine = drawn.reshape(contexts, 6)[:, 0]
        assert abs(mine.mean() - plain.mean()) < 4 * plain.std() / contexts**0.5
    assert 24 < plain.mean() < 25.5 and py.SINGLY > 200


def test_large_dishes_are_seated_in_steps_of_tables():
    from tideline.llm.pitman_yor import draw_tables

    random = np.random.default_rng(8)
    counts = np.full(50, 10_000_000)
    drawn = draw_tables(counts, np.zeros(50), np.full(50, 1e-3), 1.0, 0.5, random)
    assert (drawn >= 1).all() and drawn.mean() < 60
    # Many tables of a large dish, seated in runs.
    drawn = draw_tables(np.full(2, 3_000_000), np.full(2, 200_000.0), np.full(2, 0.5), 1.0, 0.8, random)
    assert (drawn > 200_000).all()


def test_scores_hardly_depend_on_the_blocks(spark, monkeypatch):
    from tideline.llm import pitman_yor

    docs = given(spark)
    scores = []
    for size in (1 << 24, 150_000):
        monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", size)
        scores.append({r.doc_id: r.score / r.n_tokens for r in pitman_yor.lm_scores(docs).collect()})
    # Draws differ; the model does not. In log10 per token.
    off = [abs(scores[1][d] - s) for d, s in scores[0].items()]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.01


def test_scores_of_a_tiny_corpus_by_hand(texts):
    """With one customer everywhere there is one seating, whose probabilities are written out."""
    from tideline.llm.pitman_yor import lm_scores

    rows = [(1, "a b"), (2, "c")]
    held = [d for d in range(3, 200) if brute.base_scores([(d, "")])[0][0]][0]
    found = {r.doc_id: r.score for r in lm_scores(texts([*rows, (held, "a c")])).collect()}
    # Contexts: start (a, c), a (b), b (end), c (end); the root has a, b, c once and the end twice.
    d, d0 = 0.8, 0.7
    assert not any(x[0] for x in brute.base_scores(rows))
    possible = set()
    for seats_end in (1, 2):
        tables = 3 + seats_end
        base = (1.0 + d0 * tables) / 5
        root = {w: (1 - d0 + base) / 6.0 for w in "abc"} | {"end": (2 - d0 * seats_end + base) / 6.0}
        after_start = lambda w: (1 - d + (1 + 2 * d) * root[w]) / 3.0
        other = (1 + d) * root["c"] / 2.0
        ends = (1 - d + (1 + d) * root["end"]) / 2.0
        possible.add(np.log10(after_start("a") * other * ends))
    low, high = min(possible), max(possible)
    assert low - 1e-5 <= found[held] <= high + 1e-5


# --- licences ------------------------------------------------------------------------------------


def base_places(text):
    from tideline.llm.license_templates import BASE_PHRASES

    words, held = [], ""
    for c in brute.ascii_lower(text or ""):
        if c.isascii() and not (c.isdigit() or c.isalpha()):
            words.append(held)
            held = ""
        else:
            held += c
    words = [w for w in [*words, held] if w]
    places = [
        (i, label)
        for phrase, label in BASE_PHRASES
        for i in range(len(words) - len(phrase.split()) + 1)
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


@needs_tables
def test_licenses_of_given_and_odd_rows(spark, texts, odd_rows):
    from tideline.llm.licenses import license_scan

    for docs in (given(spark), texts(odd_rows, extra=True)):
        expected = Counter((d, *base_places(t)) for d, t in pairs_of(docs))
        found = license_scan(docs).collect()
        assert as_counter(r[:6] for r in found) == expected
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_license_spans_chain_over_small_changes():
    from tideline.llm.license_templates import TEMPLATES
    from tideline.llm.licenses import LicenseScanner, license_words

    scanner = LicenseScanner()
    for label, text in TEMPLATES:
        n, _, spans = scanner.scan(f"some words first. {text} and after")
        assert (3, n - 2, label, 1.0) in spans
    mit = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 100)
    words = mit.split()
    words[20] = "changed"
    spans = scanner.scan(" ".join(words))[2]
    assert [s[:3] for s in spans if s[2] == "mit"] == [(0, len(license_words(mit)), "mit")]
    assert not scanner.scan(" ".join(reversed(words)))[2]


def test_no_pair_of_edits_loses_a_template():
    """Two words of a template of 30 or more are replaced, by unknown words or by words of templates."""
    from tideline.llm.license_templates import TEMPLATES
    from tideline.llm.licenses import LicenseScanner, license_words

    scanner = LicenseScanner()
    for label, text in TEMPLATES:
        words = [w.decode() for w in license_words(text)]
        if len(words) < 30:
            continue
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                held = words.copy()
                held[i], held[j] = ("replicate", "within") if (i + j) % 2 else ("the", "software")
                assert label in {s[2] for s in scanner.scan(" ".join(held))[2]}, (label, i, j)


def best_cover(text, template, least_run, most_gap):
    """The most words that a chain covers, over all chains of maximal common runs."""
    runs = []
    for e in range(1, len(text) + 1):
        for p in range(1, len(template) + 1):
            n = 0
            while n < min(e, p) and text[e - 1 - n] == template[p - 1 - n]:
                n += 1
            runs.append((e, p, n))
    # As the scanner has it: the longest run of the template that ends at a word, unless the next word prolongs it.
    longest = [max((n for e, p, n in runs if e == end), default=0) for end in range(len(text) + 2)]
    anchors = [
        (e, p - 1, n) for e, p, n in runs
        if n >= min(least_run, len(template)) and n == longest[e] and not (e < len(text) and longest[e + 1] == n + 1)
    ]
    anchors.sort()
    best = []
    for i, (e, p, n) in enumerate(anchors):
        best.append(max([n] + [
            best[j] + min(n, e - f, p - q) for j, (f, q, _) in enumerate(anchors[:i]) if f < e and q < p and e - n - f <= most_gap
        ]))
    return max(best, default=0)


def test_chains_cover_as_much_as_any():
    import random

    from tideline.llm.licenses import LicenseScanner

    draw = random.Random(6)
    for _ in range(150):
        template = [draw.choice("abcd") for _ in range(draw.randint(4, 12))]
        other = [draw.choice("abcde") for _ in range(6)]
        scanner = LicenseScanner((), (("x", " ".join(template)), ("y", " ".join(other))), least_run=2, most_gap=3, least_cover=0.01)
        text = [w if draw.random() < 0.8 else draw.choice("abcdz") for w in template + other + template[::-1]]
        spans = [s for s in scanner.scan(" ".join(text))[2] if s[2] == "x"]
        most = best_cover(text, template, 2, 3)
        assert max((s[3] for s in spans), default=0) == pytest.approx(min(1, most / len(template)))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_phrase_may_be_one_word():
    from tideline.llm.licenses import LicenseScanner

    n, phrases, spans = LicenseScanner((("copyleft", "left"),), ()).scan("No copyleft, no Copyleft here")
    assert (n, phrases, spans) == (5, [(1, 2, "left"), (3, 4, "left")], [])


# --- quality, fingerprints -----------------------------------------------------------------------


def test_quality_of_odd_rows(texts, odd_rows):
    from tideline.llm.quality import keep_clean, quality_table

    docs = texts(odd_rows, extra=True)
    spaces = " \t\n\x0b\f\r"
    expected = []
    for d, t in odd_rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = [False] * len(words)
        for i in range(len(words) - 7):
            if windows[tuple(words[i : i + 8])] > 1:
                repeated[i : i + 8] = [True] * 8
        lines = [x for x in t.split("\n") if x.strip(spaces)]
        n = len(words)
        failed = n < 20 or 100 * sum(repeated) > 30 * n
        expected.append(
            (d, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(repeated), failed)
        )
    found = quality_table(docs).collect()
    assert as_counter(r[:7] for r in found) == Counter(expected)
    assert not any(r.kept and r.base_failed for r in found)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if r.kept)


def test_order_of_rules_changes_nothing(texts, odd_rows):
    from tideline.llm import quality

    docs = texts(odd_rows)
    rules = quality.default_rules()
    verdicts = []
    for order in (rules, rules[::-1]):
        table = quality.measured(docs.withColumn("text", F.coalesce("text", F.lit(""))))
        verdicts.append(as_counter(table.select("doc_id", quality.cascade(order).isNull()).collect()))
    assert verdicts[0] == verdicts[1]


def test_fingerprints_of_odd_rows(texts, odd_rows):
    from tideline.llm.merkle import fingerprints

    rows = [(d, t or "") for d, t in odd_rows]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    expected = Counter()
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        quarter = len(t) // 4
        expected[d, len(t), brute.sha(t[: len(t) - quarter] + following[:quarter])] += 1
    found = fingerprints(texts(odd_rows, extra=True)).collect()
    assert as_counter(r[:3] for r in found) == expected
    by_text = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {10, 12} in by_text.values()
    assert {1, 5} in by_text.values()
    alone = fingerprints(texts([(7, "abcdefgh")])).first()
    assert alone.edited_sha256 == brute.sha("abcdefab") and alone.near_next == 1.0


def test_likeness_survives_an_insertion(texts):
    from tideline.llm.merkle import fingerprints

    line = " ".join(f"word{i * 7919 % 1009}" for i in range(150))
    blankless = "".join(chr(0x4E00 + i * 7919 % 5003) for i in range(600)) + "\U0001f600" * 3
    docs = [(1, line), (2, "put " + line), (3, blankless), (4, "x" + blankless), (5, "short"), (6, "a\nshort"), (7, "")]
    near = {r.doc_id: r.near_next for r in fingerprints(texts(docs)).collect()}
    assert near[1] > 0.95 and near[3] > 0.95
    assert near[2] < 0.01 and near[5] == 0.5 and near[6] == 0


def differing(x, y):
    """Start, ends and places of the stretch in which two lists differ."""
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    tail = 0
    while tail < min(len(x), len(y)) - start and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    ends = len(x) - tail, len(y) - tail
    return ends, range(start, max(ends))


def places_of_edits(x, y):
    out = []
    x, y = (t.split("\n\n") for t in (x, y))
    (xe, ye), places = differing(x, y)
    for i in places:
        p, q = (t[i].split("\n") if i < e else [] for t, e in ((x, xe), (y, ye)))
        (pe, qe), inner = differing(p, q)
        out += [(i, j) for j in inner if (p[j] if j < pe else None) != (q[j] if j < qe else None)]
    return out


def test_edits_are_located_from_the_root_down(spark):
    import random

    from tideline.llm.merkle import changed_places, tree

    draw = random.Random(4)
    base = "\n\n".join("\n".join(f"line {s} {p}" for p in range(4)) for s in range(5))
    lines = base.split("\n")
    pairs = [
        (base, base), (base, "new\n" + base), (base, "new\n\n" + base), (base, base.replace("line 2 1\n", "")),
        (base, base.replace("line 1 3", "x").replace("line 3 0", "y").replace("line 3 2", "z")), ("", base), (base, ""), ("", ""),
        (base, base.replace("line 0 1", "line 0 1\nput in").replace("line 4 2", "other")),
    ]
    for _ in range(40):
        held = lines.copy()
        for _ in range(draw.randint(1, 4)):
            at = draw.randrange(len(held))
            held[at : at + draw.randint(0, 2)] = draw.choice([[], ["a"], ["", "b"], ["line 2 2"]])
            held = held or [""]
        pairs.append((base, "\n".join(held)))
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    found = {r.i: [tuple(c) for c in r.c] for r in df.select("i", changed_places(tree(F.col("x")), tree(F.col("y"))).alias("c")).collect()}
    assert found == {i: places_of_edits(x, y) for i, (x, y) in enumerate(pairs)}
    assert found[0] == [] and found[1] == [(0, 0)] and found[3] == [(2, 1)] and found[4] == [(1, 3), (3, 0), (3, 2)]
    assert found[2] == [(0, 0)]


# --- tokenizers ----------------------------------------------------------------------------------

STRANGE = ["", " ", "  a  b ", "▁", "a▁b", "<unk>", "<s>", "<0x41>", "\x00", "漢字 かな", "\U0001f600x", "é", "a\n\n b\t\r\n", "�"]


def tokenizer_texts(spark):
    found = [t for _, t in pairs_of(given(spark))] if os.path.isdir(FOLDER) else []
    random = np.random.default_rng(6)
    letters = list("abe \n▁é漢\U0001f600<>x") + ["the ", "ing", "    "]
    return STRANGE + ["".join(random.choice(letters, n)) for n in range(300)] + found + ["xyz" * 5000, " " * 999]


def test_pieces_match_the_library(spark, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    from tideline.llm.pieces import digests, encoded
    from tideline.llm.queries import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(tokenizer_texts(spark)), (None, "null id"), (3, None)]
    docs = texts(rows, extra=True)
    expected, hashed = Counter(), Counter()
    for d, t in rows:
        ids = library.encode(t or "")
        decoded = library.decode(ids)
        expected[d, tuple(ids), decoded] += 1
        hashed[d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(decoded)] += 1
    found = encoded(docs, path)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found.collect()) == expected
    assert as_counter(digests(found).collect()) == hashed


@pytest.mark.parametrize("with_bytes", [True, False])
def test_counts_match_the_library(spark, texts, with_bytes):
    tokenizers = pytest.importorskip("tokenizers")
    from tideline.llm import counts
    from tideline.llm.queries import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    vocabulary = counts.unigram_vocabulary(path)
    if not with_bytes:
        vocabulary = [x for x in vocabulary if not x[0].startswith("<0x")]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=with_bytes))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rare = ["\U0001f600\U0001f601x", "\u4e02\u4e04" * 500, "<unk>", "<unk><unk>", "\U0001f600<unk>", "a<unk>b", "<0x41>\u4e02", "<unk>\u4e02 <unk>"]
    plain = [*tokenizer_texts(spark), *rare]
    counter = counts.UnigramCounter(vocabulary)
    assert [counter.count(t)[0] for t in plain] == [len(library.encode(t, add_special_tokens=False).ids) for t in plain]
    assert counter.has_bytes == with_bytes
    if with_bytes:
        rows = [*enumerate(plain), (None, "null id"), (3, None)]
        expected = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
        assert as_counter(r[:2] for r in counts.token_counts(texts(rows, extra=True), path).collect()) == expected


# --- packing -------------------------------------------------------------------------------------


def test_boundaries_have_the_least_padding():
    from itertools import combinations

    from tideline.llm.packing import optimal_boundaries

    random = np.random.default_rng(7)
    for m, buckets in ((1, 3), (5, 2), (9, 3), (10, 4), (10, 20)):
        tops = np.sort(random.choice(200, m, replace=False)) + 1
        counts = random.integers(1, 50, m)

        def padded(ends):
            return sum(c * min(e for e in ends if e >= t) for t, c in zip(tops, counts))

        best = min(
            padded([*ends, tops[-1]])
            for k in range(min(buckets, m))
            for ends in combinations(tops[:-1].tolist(), k)
        )
        assert padded(optimal_boundaries(tops, counts, buckets)) == best


def test_long_lengths_pad_to_the_longest_of_their_bucket(spark):
    from tideline.llm.packing import packed

    lengths = [3, 4_097, 5_000, 5_001, 123_457, 9_999_999]
    rows = packed(spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, length bigint"), buckets=16).collect()
    assert {r.length: r.padded_length for r in rows} == {n: n for n in lengths}
    some = packed(spark.createDataFrame([(i, 4_000 + 7 * i) for i in range(3_000)], "doc_id bigint, length bigint"), buckets=3)
    longest = {r.bucket: r.n for r in some.groupBy("bucket").agg(F.max("length").alias("n")).collect()}
    assert all(r.padded_length == longest[r.bucket] for r in some.collect())


def test_batches_are_full_and_whole(spark):
    from tideline.llm.packing import packed

    random = np.random.default_rng(8)
    lengths = [0, 0, 5, 300, 20_000, *random.integers(1, 400, 3000).tolist()]
    rows = [(i, n) for i, n in enumerate(lengths)] + [(None, 7), (1, None), (2, 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, length bigint").selectExpr("*", "1 AS bucket", "2 AS _n")
    found = packed(table, token_budget=4096, buckets=6).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter((d, n or 0) for d, n in rows)
    assert all(r.length <= r.padded_length and r.padding == r.padded_length - r.length for r in found)
    batches = Counter((r.bucket, r.padded_length, r.batch) for r in found)
    last = {}
    for bucket, _, batch in batches:
        last[bucket] = max(last.get(bucket, 0), batch)
    for (bucket, length, batch), n in batches.items():
        full = max(1, 4096 // max(length, 1))
        assert n <= full and (n == full or batch == last[bucket])
    assert len({(r.bucket, r.batch, r.place) for r in found}) == len(found)


def test_cells_hold_their_lengths(spark):
    from tideline.llm.packing import cell_of

    lengths = [0, 1, 4095, 4096, 4097, 8191, 8192, 8193, 100_001, 12_345_678]
    rows = spark.createDataFrame([(n,) for n in lengths], "length bigint").select("length", cell_of(F.col("length"))).collect()
    for n, top in rows:
        assert n <= top <= max(n, n * (1 + 1 / 500)) and (n > 4096 or top == n)


# --- all -----------------------------------------------------------------------------------------


def test_empty_tables(texts):
    from tideline.llm import counts, licenses, merkle, near, packing, pieces, pitman_yor, quality, substrings, suffixes
    from tideline.llm.queries import tokenizer_path

    none = texts([])
    path = tokenizer_path("piece_bpe_32k.model")
    for table in (
        pitman_yor.lm_scores(none),
        licenses.license_scan(none),
        quality.quality_table(none),
        quality.keep_clean(none),
        substrings.substring_dedup(none),
        counts.token_counts(none, path),
        near.near_duplicates(none),
        near.keep_one_of_each(none),
        packing.packed(none.select("doc_id", F.col("n_chars").alias("length"))),
        suffixes.suffix_dedup(none),
        suffixes.cut_repeats(none),
        pieces.digests(pieces.encoded(none, path)),
        merkle.fingerprints(none),
    ):
        assert table.count() == 0


def test_native_operators_run_no_python(texts):
    from tideline.llm.merkle import fingerprints
    from tideline.llm.quality import keep_clean, quality_table

    docs = texts([(1, "a b c"), (2, "d")])
    for df in (fingerprints(docs), quality_table(docs), keep_clean(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
