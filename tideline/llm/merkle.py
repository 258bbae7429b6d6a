"""Document fingerprints: a Merkle tree over sections and paragraphs, with windows of characters.

A text is split into sections at empty lines, a section into paragraphs at line ends. A paragraph's
digest is the hash of its text, a section's that of its paragraphs' digests, the root's that of the
sections'. Splitting loses nothing, so equal roots mean equal texts. Two texts are compared from the
root down: equal sections at both ends are passed over, and only differing ones are looked into, where
the paragraphs are compared in the same way; that gives the places of all edits. How alike two texts
are is the share of windows they have in common: runs of a few characters that start at every
character of a line, so an edit of any length changes only the windows that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.texts import id_and_text, let

#: Code points in a window.
WINDOW_CHARS = 8


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def tree(text: Column) -> Column:
    """Sections with their ``digest`` and their ``paragraphs``' digests. The level's letter keeps a paragraph from passing for a section."""
    digests = F.transform(
        F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: _sha(F.concat(F.lit("P"), p)))
    )
    return F.transform(
        digests,
        lambda ps: F.struct(_sha(F.concat(F.lit("S"), F.concat_ws(",", ps))).alias("digest"), ps.alias("paragraphs")),
    )


def root(sections: Column) -> Column:
    return _sha(F.concat(F.lit("R"), F.concat_ws(",", F.transform(sections, lambda s: s["digest"]))))


def _equal_start(a: Column, b: Column, most: Column) -> Column:
    """How many digests two lists have in common from their starts on, up to ``most``."""
    differ = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x != y)
    return let(F.array_position(differ, F.lit(True)).cast("int"), lambda at: F.when(at == 0, most).otherwise(at - 1))


def _differing(a: Column, b: Column) -> Column:
    """The stretch in which two lists of digests differ: its ``start`` in both, and its ends."""
    n = F.least(F.size(a), F.size(b))
    return let(
        _equal_start(a, b, n),
        lambda start: let(
            _equal_start(F.reverse(a), F.reverse(b), n - start),
            lambda tail: F.struct(
                start.alias("start"), (F.size(a) - tail).alias("a_end"), (F.size(b) - tail).alias("b_end")
            ),
        ),
    )


def _places(stretch: Column) -> Column:
    """Numbers from 0 in the stretch; as many as the longer side has."""
    none = F.array().cast("array<int>")
    end = F.greatest(stretch["a_end"], stretch["b_end"])
    return F.when(end > stretch["start"], F.sequence(stretch["start"], end - 1)).otherwise(none)


def _within(list_: Column, place: Column, end: Column) -> Column:
    return F.when(place < end, F.get(list_, place))


def changed_places(a: Column, b: Column) -> Column:
    """Sections and paragraphs, from 0, at which two trees differ.

    Equal sections at both ends are left out, then equal ones at the same place; in a pair that
    differs, the same is done with its paragraphs. What one side lacks counts as different.
    """
    digests = lambda t: F.transform(t, lambda s: s["digest"])
    nothing = F.array().cast("array<string>")

    def in_section(section: Column, x: Column, y: Column) -> Column:
        ps, qs = F.coalesce(x["paragraphs"], nothing), F.coalesce(y["paragraphs"], nothing)
        return let(
            F.struct(ps.alias("ps"), qs.alias("qs")),
            lambda held: let(
                _differing(held["ps"], held["qs"]),
                lambda d: F.transform(
                    F.filter(
                        _places(d),
                        lambda j: ~_within(held["ps"], j, d["a_end"]).eqNullSafe(_within(held["qs"], j, d["b_end"])),
                    ),
                    lambda j: F.struct(section.alias("section"), j.alias("paragraph")),
                ),
            ),
        )

    return let(
        _differing(digests(a), digests(b)),
        lambda d: F.flatten(
            F.transform(
                _places(d), lambda i: in_section(i, _within(a, i, d["a_end"]), _within(b, i, d["b_end"]))
            )
        ),
    )


def window_list(text: Column, window_chars: int = WINDOW_CHARS) -> Column:
    """Digests of all runs of ``window_chars`` in a line; a shorter line is one itself.

    The look-ahead takes the run and the match one code point, so the runs overlap.
    """
    run = f"[^\\n]{{{window_chars}}}"
    line = f"(?<![^\\n])[^\\n]{{1,{window_chars}}}(?![^\\n])"
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"(?=({run}|{line}))[^\\n]"), F.lit(1)), lambda x: F.xxhash64(x)
    )


def _likenesses(text: Column, edited: Column, following: Column, kept: Column) -> Column:
    """Likeness of a text to its edited form and to the next text.

    The first ``kept`` code points of both forms are the same; their whole lines are looked at once.
    """
    lines = F.regexp_extract(F.substring(text, F.lit(1), kept), r"(?s)^(.*\n)", 1)
    rest = lambda whole, n: F.array_distinct(F.concat(n["same"], window_list(F.substring(whole, n["from"], F.lit(1 << 30)))))
    return let(
        let(lines, lambda x: F.struct(window_list(x).alias("same"), (F.char_length(x) + 1).alias("from"))),
        lambda n: let(
            rest(text, n),
            lambda own: F.struct(
                likeness(own, rest(edited, n)).alias("edited"),
                likeness(own, F.array_distinct(window_list(following))).alias("next"),
            ),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared windows by all windows of two sets; 1 when both are empty."""
    both = let(b, lambda b: F.struct(F.size(F.array_intersect(a, b)).alias("n"), (F.size(a) + F.size(b)).alias("all")))
    return let(both, lambda x: F.when(x["all"] == 0, F.lit(1.0)).otherwise(x["n"] / (x["all"] - x["n"])))


def with_next(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, the text of the next document by ascending id.

    Ids are cut into ``groups`` ranges of about equal rows, by default one per shuffle partition;
    the cuts, not the ids, reach the driver. Inside a range a window looks one row ahead. The
    first text of each range goes to the last row of the range before it, and the first of all to
    the last of all. Rows with one id stand in the order of their texts; null ids come last.
    """
    spark = docs.sparkSession
    own = id_and_text(docs)
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [F.lit(i / groups) for i in range(1, groups)]
    cuts: list[int] = []
    if shares:
        cuts = own.agg(F.percentile_approx("doc_id", F.array(*shares), F.lit(10_000)).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    # Null ids count as beyond every cut.
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(edges, lambda c: c < F.col("doc_id")))
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    inside = Window.partitionBy("_g").orderBy(*order)
    held = own.withColumn("_g", place).select(
        "doc_id",
        "text",
        "_g",
        F.lead("text").over(inside).alias("_ahead"),
        F.row_number().over(inside).alias("_n"),
    )
    # One row per range: its place in the order of ranges that have rows, and its first text.
    first = held.where(F.col("_n") == 1).select("_g", F.col("text").alias("_first"))
    ranked = Window.orderBy("_g")
    firsts = first.select(
        "_g",
        F.coalesce(F.lead("_first").over(ranked), F.first("_first").over(ranked)).alias("_over"),
    )
    return held.join(firsts, "_g").select("doc_id", "text", F.coalesce("_ahead", "_over").alias("next_text"))


def with_edited(docs: DataFrame) -> DataFrame:
    """``with_next`` with ``n_chars`` and ``edited``, whose last quarter is the start of the next text, and the length of the rest."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return with_next(docs).select(
        "doc_id",
        "text",
        "next_text",
        n.cast("bigint").alias("n_chars"),
        (n - quarter).alias("_same_chars"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)
        ).alias("edited"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likenesses and the places of the edits.

    The edited text has its last quarter of code points replaced by as many first ones of the next
    document. ``changed`` holds the places at which the trees of both differ. A null text is empty; an
    empty text has one section of one empty paragraph and no windows. A single document is its own
    next. Repeated rows are each a document; other columns are not looked at; an empty table gives an
    empty table.
    """
    trees = with_edited(docs).select(
        "doc_id",
        "n_chars",
        _sha(F.col("edited")).alias("edited_sha256"),
        tree(F.col("text")).alias("_tree"),
        tree(F.col("edited")).alias("_edited_tree"),
        _likenesses(F.col("text"), F.col("edited"), F.col("next_text"), F.col("_same_chars")).alias("_near"),
    )
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("_tree")).alias("fingerprint"),
        root(F.col("_edited_tree")).alias("edited_fingerprint"),
        F.col("_near.edited").alias("near_edited"),
        F.col("_near.next").alias("near_next"),
        F.aggregate("_tree", F.lit(0).cast("bigint"), lambda n, s: n + F.size(s["paragraphs"])).alias("n_paragraphs"),
        changed_places(F.col("_tree"), F.col("_edited_tree")).alias("changed"),
    )
