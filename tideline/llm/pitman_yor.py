"""Language-model scores from a hierarchical Pitman-Yor model of words and their predecessors.

Every preceding word is a restaurant whose customers are the words that followed it in training. A
customer joins a table of its dish or opens a new one; every table is itself a customer of the root
restaurant, the parent that all contexts share, whose own tables draw from a uniform base. Words and
contexts are 64-bit hashes, counts are exact, and nothing is pruned.

Texts are held in blocks. Blocks send their distinct (context, word) pairs with training counts to
the buckets of the contexts, so a restaurant stands in one place and a frequent context arrives as
one count per block and pair. The seating is sampled by Gibbs sweeps over blocks of customers: all
customers of a dish leave and are seated again one by one, given the tables of the other dishes, those
opened so far and the parent's probabilities. Every second dish of a restaurant is seated side by side,
then the rest, given the first half's new tables.

At first every dish has one table in each restaurant, in all buckets alike, and so many customers at
the root. A first sweep gives the root its customers; the root is seated; its seats return to the
contexts, which make one sweep to settle and ``sweeps`` further ones, over which the predictive
probabilities are averaged. In each of them the root takes in the bucket's own new tables and seats the
bucket's words anew; tables of other buckets are those of the first sweep. Draws come from generators
keyed by bucket and sweep over rows in a fixed order, so a retried task repeats them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.blocks import (
    NO_ID,
    bucket_of,
    documents_of,
    expand,
    in_blocks,
    pack_sorted,
    runs_of,
    squeeze,
    text_bytes,
    unpack_sorted,
)
from tideline.llm.repeats import STEP_BYTES

#: Bytes of text in a block: fewer and larger blocks repeat fewer pairs.
BLOCK_BYTES = 16 << 20
#: Stand for the place before the first word and for the end, which is a token.
START, END = np.uint64(0x53544152545F5F5F), np.uint64(0x454E445F5F5F5F5F)
#: Customers that all dishes of a bucket seat side by side. Beyond them a dish seats a run of customers at
#: once or draws how many join before the next new table, whichever takes less; the seating is the same.
SINGLY = 256
#: Customers of a run, customers that take as long to seat as one drawn table, and tables to come up to
#: which dishes are better taken together.
RUN, RUN_PER_TABLE, FEW_TABLES = 1 << 16, 6_000, 64


@dataclass(frozen=True)
class PitmanYor:
    """Discounts and strengths of contexts and root, and the sweeps that are averaged."""

    discount: float = 0.8
    strength: float = 1.0
    root_discount: float = 0.7
    root_strength: float = 1.0
    sweeps: int = 4
    seed: int = 7


def held_out(doc_id: int) -> bool:
    """Documents that are not learned from: a tenth by the checksum of the id as text."""
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % 10 == 0


def _log_gamma_rise(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithm of ``z (z + 1) ... (z + n - 1)`` for ``z`` of 30 or more, by Stirling's series."""
    end = z + n
    correction = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (z - 0.5) * np.log1p(n / z) + n * (np.log(end) - 1) + correction(end) - correction(z)


def _joined_before_new(z: np.ndarray, mass: np.ndarray, most: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Customers who sit down at open tables before the next opens one, up to ``most``.

    The next customer joins with probability ``z / (z + mass)``, the one after with ``z`` larger by one.
    """
    wanted = np.log(chance)
    low, high = np.zeros(len(z)), most.astype(np.float64)
    # The chance that all of ``n`` join falls with n; the answer is the largest n at which it is not below the draw.
    while (low < high).any():
        middle = np.ceil((low + high) / 2)
        stays = _log_gamma_rise(z, middle) - _log_gamma_rise(z + mass, middle) >= wanted
        low, high = np.where(stays, middle, low), np.where(stays, high, middle - 1)
    return low


def _seated_run(n: int, t: float, first: float, grown: float, discount: float, random: np.random.Generator) -> float:
    """Tables of a dish once customers ``SINGLY`` to ``n`` have come one after the other.

    Whether a customer opens a table depends on the tables opened before: that is solved for a run of
    customers at once, from no table on, until nothing changes. A run is at most as long as the
    customers before it, so a few rounds do.
    """
    k = SINGLY
    while k < n:
        size = min(n - k, k, RUN)
        chance, seats = random.random(size), np.arange(k, k + size)
        opens = np.zeros(size, bool)
        while True:
            tables = t + np.cumsum(opens) - opens
            mass = first + grown * tables
            again = chance * (mass + seats - discount * tables) < mass
            if (again == opens).all():
                break
            opens = again
        t += opens.sum()
        k += size
    return t


def draw_tables(
    counts: np.ndarray,
    others: np.ndarray,
    parent: np.ndarray,
    strength: float,
    discount: float,
    random: np.random.Generator,
) -> np.ndarray:
    """Tables of dishes with ``counts`` customers, seated one after the other.

    The customer after ``k`` others at ``t`` tables opens one with a weight of
    ``(strength + discount * (others + t)) * parent`` against ``k - discount * t``. ``others`` are the
    restaurant's tables of other dishes, ``parent`` the dish's probability there.
    """
    tables = (counts > 0).astype(np.float64)
    order = np.argsort(-counts, kind="stable")
    n, t = counts[order], tables[order]
    first = ((strength + discount * others) * parent)[order]
    grown = discount * np.broadcast_to(parent, counts.shape)[order]
    live = len(n)
    for k in range(1, SINGLY):
        live = int(np.searchsorted(-n[:live], -k, side="left"))
        if not live:
            break
        mass = first[:live] + grown[:live] * t[:live]
        t[:live] += random.random(live) * (mass + k - discount * t[:live]) < mass
    at = np.arange(int(np.searchsorted(-n[:live], -SINGLY, side="left")))
    mass = first[at] + grown[at] * t[at]
    tables_to_come = mass * np.log1p(n[at] / (mass + 1e-300))
    in_runs = (tables_to_come > FEW_TABLES) & (n[at] < RUN_PER_TABLE * tables_to_come)
    for i in at[in_runs].tolist():
        t[i] = _seated_run(int(n[i]), float(t[i]), float(first[i]), float(grown[i]), discount, random)
    at = at[~in_runs]
    seated = np.full(len(at), float(SINGLY))
    while len(at):
        z, mass = seated - discount * t[at], first[at] + grown[at] * t[at]
        seated = seated + _joined_before_new(z, mass, n[at] - seated, 1 - random.random(len(at)))
        opens = seated < n[at]
        t[at[opens]] += 1
        at, seated = at[opens], seated[opens] + 1
        left = seated < n[at]
        at, seated = at[left], seated[left]
    tables[order] = t
    return tables


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tokens per document, contexts and tokens of a block."""
    ids, texts, _ = documents_of(table)
    hashes, sizes = [np.empty(0, np.uint64)], []
    for a, b in runs_of([len(t) for t in texts], STEP_BYTES):
        for text in texts[a:b]:
            words = text.lower().split()
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            sizes.append(len(words) + 1)
    words = np.concatenate(hashes)
    sizes = np.array(sizes, np.int64)
    stops = np.cumsum(sizes)
    tokens, contexts = np.empty(len(words) + len(sizes), np.uint64), np.empty(len(words) + len(sizes), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[stops - 1] = True
    is_start = np.zeros(len(tokens), bool)
    is_start[stops - sizes] = True
    tokens[is_end], tokens[~is_end] = END, words
    contexts[is_start], contexts[~is_start] = START, words
    return ids, sizes, contexts, tokens


def _distinct_pairs(contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the pairs, the first place of each distinct one in it, and each pair's number."""
    order = np.lexsort((tokens, contexts))
    u, w = contexts[order], tokens[order]
    new = np.ones(len(order), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _firsts(ascending: np.ndarray) -> np.ndarray:
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


_ASKED = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int32())] + [(n, pa.binary()) for n in ("contexts", "fans", "words", "counts")]
)
_TABLES = pa.schema(
    [("shard", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("tables", pa.binary()), ("tokens", pa.int64())]
)
_ROOT = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int32())]
    + [(n, pa.binary()) for n in ("given", "held", "seats")]
    + [(n, pa.int64()) for n in ("dishes", "customers", "root_tables", "tokens")]
)
_ANSWERS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("probs", pa.binary()), ("counts", pa.binary())])
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [(n, pa.int64()) for n in ("n_words", "n_known_words")]
    + [(n, pa.float64()) for n in ("base_words", "score")]
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int32": "int", "int64": "bigint", "binary": "binary", "bool": "boolean", "double": "double"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _slices(ascending: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    held = bucket_of(ascending, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [len(held)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(held[a]), a, b


class _Restaurants:
    """The context restaurants of one bucket, merged from what the blocks asked."""

    def __init__(self, asked: pa.Table, model: PitmanYor):
        self.model = model
        rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
        self.blocks = [r["block"] for r in rows]
        self.bucket = rows[0]["bucket"]
        contexts, fans = [unpack_sorted(r["contexts"]) for r in rows], [expand(r["fans"], np.uint32) for r in rows]
        self.asked_contexts = contexts
        u = np.concatenate([np.repeat(c, f) for c, f in zip(contexts, fans)])
        w = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        counts = np.concatenate([expand(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        self.asked_pairs = [int(f.sum()) for f in fans]
        order, first, self.number = _distinct_pairs(u, w)
        self.counts = np.add.reduceat(counts[order], first)
        del counts
        pair_u, pair_w = u[order[first]], w[order[first]]
        del u, w, order
        start = _firsts(pair_u)
        self.contexts = pair_u[start]
        self.context = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pair_u))))
        self.starts = start
        self.customers = np.add.reduceat(self.counts, start)
        self.words, self.word = np.unique(pair_w, return_inverse=True)

    def alone(self) -> np.ndarray:
        """One table per dish that was seen in training."""
        return (self.counts > 0).astype(np.float64)

    def fans(self) -> np.ndarray:
        """Restaurants that serve each word."""
        return np.bincount(self.word, self.counts > 0, len(self.words))

    def random(self, sweep: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[self.model.seed, (self.bucket << 8) + sweep]))

    def seated(self, parent: np.ndarray, drawn: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """One sweep: tables per pair, given the parent's probabilities and the tables so far."""
        m = self.model
        drawn = drawn.copy()
        rank = np.arange(len(self.counts)) - self.starts[self.context]
        for half in (0, 1):
            # One customer has one table.
            some = np.flatnonzero((self.counts > 1) & (rank % 2 == half))
            others = self.per_context(drawn)[self.context[some]] - drawn[some]
            drawn[some] = draw_tables(self.counts[some], others, parent[self.word[some]], m.strength, m.discount, random)
        return drawn

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def first_sweep(self, root: "_Root") -> np.ndarray:
        """Tables per pair after the sweep that follows one table per dish."""
        return self.seated(root.probabilities(), self.alone(), self.random(0))


class _Root:
    """What a bucket knows of the root: its own words' customers and seats, and the totals of all words."""

    def __init__(self, replies: pa.Table, model: PitmanYor):
        rows = sorted(replies.to_pylist(), key=lambda r: r["shard"])
        self.model = model
        self.dishes, self.customers, self.tables = rows[0]["dishes"], rows[0]["customers"], rows[0]["root_tables"]
        self.given, self.held, self.seats = (
            np.concatenate([expand(r[n], np.uint32) for r in rows]).astype(np.float64) for n in ("given", "held", "seats")
        )

    def take(self, tables: np.ndarray, random: np.random.Generator) -> None:
        """The bucket's words have ``tables`` now; their customers at the root are seated anew."""
        m = self.model
        self.customers += (tables - self.given).sum()
        self.held += tables - self.given
        self.given = tables
        seats = draw_tables(
            self.held, self.tables - self.seats, np.full(len(tables), 1 / (self.dishes + 1)), m.root_strength, m.root_discount, random
        )
        self.tables += (seats - self.seats).sum()
        self.seats = seats

    def probabilities(self) -> np.ndarray:
        """Of the bucket's words; over all words and the one unknown word they sum to one."""
        m = self.model
        base = (m.root_strength + m.root_discount * self.tables) / (self.dishes + 1)
        return (self.held - m.root_discount * self.seats + base) / (m.root_strength + self.customers)


def lm_scores(docs: DataFrame, model: PitmanYor = PitmanYor()) -> DataFrame:
    """Every text scored by the model and by a smoothed unigram base.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``perplexity``, 10 to the negative score per token. Scores are log10 of the text's
    probability. A null or empty text is one end token. A null id counts as an empty one and is held
    out. Repeated rows count as often as they stand; other columns are not looked at. Without
    training documents every token has the base's uniform probability.
    """
    blocks_n = max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    buckets = blocks_n
    blocks = in_blocks(docs, blocks_n)
    train_docs = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()

    def ask(table: pa.Table) -> pa.Table:
        ids, sizes, contexts, tokens = _tokens(table)
        train = np.repeat([not held_out(int(i)) for i in ids], sizes)
        order, first, _ = _distinct_pairs(contexts, tokens)
        counts = np.add.reduceat(train[order].astype(np.uint32), first).astype(np.uint32)
        u, w = contexts[order[first]], tokens[order[first]]
        block = table.column("block")[0].as_py()
        rows = []
        for bucket, a, b in _slices(u, buckets):
            start = _firsts(u[a:b])
            fans = np.diff(np.append(start, b - a)).astype(np.uint32)
            rows.append((bucket, block, pack_sorted(u[a:b][start]), squeeze(fans), w[a:b].tobytes(), squeeze(counts[a:b])))
        return _table(_ASKED, rows)

    def shares(own: _Restaurants, tables: np.ndarray) -> pa.Table:
        """Tables per word of a bucket, by the shard of the root that seats them."""
        tokens, given = int(own.counts.sum()), tables.astype(np.uint32)
        rows = []
        for shard, a, b in _slices(own.words, buckets):
            rows.append((shard, own.bucket, pack_sorted(own.words[a:b]), squeeze(given[a:b]), tokens))
            tokens = 0
        return _table(_TABLES, rows)

    def count_fans(table: pa.Table) -> pa.Table:
        own = _Restaurants(table, model)
        return shares(own, own.fans())

    def to_root(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = _Restaurants(table, model)
        drawn = own.first_sweep(_Root(replies, model))
        return shares(own, np.bincount(own.word, drawn, len(own.words)))

    def root(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        asked = [unpack_sorted(r["words"]) for r in rows]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        given = [expand(r["tables"], np.uint32) for r in rows]
        held = np.bincount(place, np.concatenate(given), len(words)).astype(np.int64)
        shard = rows[0]["shard"]
        random = np.random.Generator(np.random.Philox(key=[model.seed, (shard << 8) + 255]))
        # Nearly every dish has one root table; the contexts seat their words again with all tables known.
        served = (held > 0).sum()
        seats = draw_tables(held, np.full(len(words), served - 1.0), np.full(len(words), 1 / (served + 1)), model.root_strength, model.root_discount, random)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        out = [(-1, shard, None, None, None, int(served), int(held.sum()), int(seats.sum()), sum(r["tokens"] for r in rows))]
        out += [
            (r["bucket"], shard, squeeze(own), squeeze(held[p].astype(np.uint32)), squeeze(seats[p].astype(np.uint32)), 0, 0, 0, 0)
            for r, own, p in zip(rows, given, np.split(place, cuts))
        ]
        return _table(_ROOT, out)

    def answer(table: pa.Table, replies: pa.Table) -> pa.Table:
        own, above = _Restaurants(table, model), _Root(replies, model)
        drawn = own.alone()
        probs = np.zeros(len(own.counts))
        for sweep in range(model.sweeps + 1):
            random = own.random(sweep + 1)
            parent = above.probabilities()
            drawn = own.seated(parent, drawn, random)
            above.take(np.bincount(own.word, drawn, len(own.words)), random)
            if not sweep:
                continue
            seats = own.per_context(drawn)
            backoff = (model.strength + model.discount * seats)[own.context] * above.probabilities()[own.word]
            probs += (own.counts - model.discount * drawn + backoff) / (model.strength + own.customers)[own.context]
        probs = (probs / model.sweeps).astype(np.float32)
        out, at = [], 0
        for block, contexts, pairs in zip(own.blocks, own.asked_contexts, own.asked_pairs):
            counts = own.customers[np.searchsorted(own.contexts, contexts)].astype(np.uint32)
            out.append((block, own.bucket, squeeze(probs[own.number[at : at + pairs]]), squeeze(counts)))
            at += pairs
        return _table(_ANSWERS, out)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, contexts, tokens = _tokens(table)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        probs = np.concatenate([expand(r["probs"], np.float32) for r in rows]).astype(np.float64)
        counts = np.concatenate([expand(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        _, _, number = _distinct_pairs(contexts, tokens)
        starts = np.cumsum(sizes) - sizes
        scores = np.add.reduceat(np.log10(probs)[number], starts)
        # A word's count is its number of customers as a context.
        known = np.unique(contexts)
        held = counts[np.searchsorted(known, contexts)]
        is_start = np.zeros(len(contexts), bool)
        is_start[starts] = True
        base = np.add.reduceat(np.where(is_start, 0.0, np.log10(held + 0.1)), starts)
        n_known = np.add.reduceat((~is_start & (held > 0)).astype(np.int64), starts)
        return pa.Table.from_arrays(
            [
                pa.array([None if i == NO_ID else int(i) for i in ids], pa.int64()),
                pa.array([held_out(int(i)) for i in ids]),
                pa.array(sizes - 1),
                pa.array(n_known),
                pa.array(base),
                pa.array(scores),
            ],
            schema=_SCORES,
        )

    names = ("dishes", "customers", "root_tables", "tokens")

    def answered(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The root's replies to each bucket, and its totals in one row."""
        seated = tables.groupBy("shard").applyInArrow(root, _ddl(_ROOT))
        totals = seated.where("bucket < 0").groupBy(F.lit(1).alias("all")).agg(*[F.sum(n).alias(n) for n in names])
        replies = seated.where("bucket >= 0").select("bucket", "shard", "given", "held", "seats", F.lit(1).alias("all"))
        return replies.join(F.broadcast(totals), "all").drop("all", "tokens"), totals

    asked = blocks.groupBy("block").applyInArrow(ask, _ddl(_ASKED))
    replies, _ = answered(asked.groupBy("bucket").applyInArrow(count_fans, _ddl(_TABLES)))
    first = asked.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(to_root, _ddl(_TABLES))
    replies, totals = answered(first)
    answers = asked.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(answer, _ddl(_ANSWERS))
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _ddl(_SCORES))
    n_tokens = F.col("n_words") + 1
    per_token = F.log10(F.col("tokens") + (F.col("dishes") + 1) * 0.1)
    return (
        scored.withColumn("all", F.lit(1))
        .join(F.broadcast(totals), "all")
        .select(
            "doc_id",
            "held_out",
            n_tokens.alias("n_tokens"),
            (F.col("n_known_words") + (1 if train_docs else 0)).alias("n_known"),
            F.col("tokens").alias("train_tokens"),
            (F.col("base_words") + F.log10(F.lit(train_docs + 0.1)) - n_tokens * per_token).alias("base_score"),
            "score",
            F.pow(F.lit(10.0), -F.col("score") / n_tokens).alias("perplexity"),
        )
    )
