"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the tokens that a mask keeps of a run of tokens; the
positions that it ignores may hold other words. Seeds of the benchmark items
are joined with those of the documents, and around each hit the texts are laid
side by side: a hit counts if some window of `WINDOW` tokens (or of the item's
length, if that is less) around the seed has at least `SHARE` equal tokens.
Tokens are runs of characters other than white space and ASCII punctuation, in
lower case.

The masks miss nothing of 12 tokens or more that meets the criterion: every
window of 16 or 15 tokens with three substitutions, and of 12 to 14 with two,
holds a seed of one of them. Items of 8 to 11 tokens are found verbatim, and
with substitutions where a mask fits between them; items of `SHORT` to 7 tokens,
which no mask fits, get a seed of all their tokens and are found verbatim;
shorter ones are never reported.

The benchmark's seeds and items are broadcast only after counting: up to
`BROADCAST_SEEDS` seeds, beyond which seeds, then texts, are joined by
shuffles. Documents are not shuffled in the first case; hits are verified where
they are found and summed up per document and item before they move.

Defined results: null and empty texts have no seeds; texts of any length are
looked at whole; repeated items count once, and items of one item_id are summed
up together; hits of rows with equal doc_id are, too, those without doc_id under
a null one; counts, least and greatest places need no order, so there are no
ties; documents with no verified hit give no row; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

#: Token positions that each mask keeps.
MASKS = ((0, 1, 4, 7, 8, 9), (0, 3, 7, 9, 10, 11), (0, 1, 2, 4, 6, 7))
SPANS = tuple(1 + max(mask) for mask in MASKS)
#: The least number of tokens of an item.
SHORT = 5
WINDOW, SHARE = 16, 0.8
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), "")


def runs(lengths: tuple[int, ...] = ()) -> list[tuple[int, tuple[int, ...]]]:
    """(number, kept positions) of the masks, and of whole runs of the lengths of short items."""
    return [*enumerate(MASKS), *((-n, tuple(range(n))) for n in lengths)]


def places(words: Column, lengths: tuple[int, ...] = ()) -> Column:
    """Every place of a text at which some run fits."""
    span = min([*SPANS, *lengths])
    return F.explode_outer(F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)))


def seeds(words: Column, p: Column, lengths: tuple[int, ...] = ()) -> Column:
    """(seed, span) of each run that fits at a place (null where one does not); the run's number is part of its seed."""
    each = [F.struct(F.when(p + 1 + kept[-1] <= F.size(words), F.xxhash64(F.lit(k), *(F.get(words, p + o) for o in kept))).alias("seed"), F.lit(1 + kept[-1]).alias("span")) for k, kept in runs(lengths)]
    return F.explode(F.array(*each))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, verified hits, the first and the last token of the document in them, and the greatest share of equal tokens."""
    items = benchmark.select("item_id", "text").dropDuplicates().select("item_id", F.xxhash64("item_id", "text").alias("item"), tokens(F.col("text")).alias("item_words"))
    size = F.size("item_words")
    # seven lengths at most; none, and no cost, where all items are longer
    lengths = tuple(sorted(r[0] for r in items.where(size.between(SHORT, min(SPANS) - 1)).select(size).distinct().collect()))
    own = items.where(size >= SHORT).select("item", "item_words", places(F.col("item_words"), lengths).alias("q")).where("q IS NOT NULL").select("item", "item_words", "q", seeds(F.col("item_words"), F.col("q"), lengths).alias("s"))
    # a whole run stands for items of its own length only
    of_items = own.where("s.seed IS NOT NULL").where((F.col("s.span") >= min(SPANS)) | (F.col("s.span") == size)).select("item", "q", F.col("s.seed").alias("seed"))
    small = of_items.limit(broadcast_seeds + 1).count() <= broadcast_seeds  # a bound on its seeds bounds its items, too
    held = F.broadcast if small else lambda df: df

    texts = docs.select("doc_id", "text")
    at = lambda df, *keep: df.select(*keep, "words", places(F.col("words"), lengths).alias("p")).where("p IS NOT NULL").select(*keep, "words", "p", seeds(F.col("words"), F.col("p"), lengths).alias("s"))
    if small:
        base = texts.select("doc_id", tokens(F.col("text")).alias("words"))
        hits = at(base, "doc_id").select("doc_id", "words", "p", "s.seed", "s.span").join(held(of_items), "seed")
    else:
        keyed = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), tokens(F.col("text")).alias("words"))
        found = at(keyed, "row").select("row", "p", "s.seed", "s.span").where("seed IS NOT NULL")
        # the seed tells the runs apart: each counts, as above; only repeated rows, which keyed brings back, are merged
        hits = found.join(of_items, "seed").select("row", "p", "span", "item", "q", "seed").distinct().join(keyed, "row")
    hits = hits.join(held(items), "item")

    length = F.least(F.lit(window), F.size("item_words"))
    reach = window - 1  # tokens looked at before and behind the start of the seed
    word, own = F.col("words"), F.col("item_words")
    at = lambda a, i, k: F.when(i + k >= 0, F.get(a, i + k))
    equal = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.coalesce((at(word, F.col("p"), k) == at(own, F.col("q"), k)).cast("int"), F.lit(0)))
    # windows that start so many tokens before the seed that they can hold it
    starts = F.sequence(F.lit(0), F.greatest(length - min(SPANS), F.lit(0)))
    best = F.array_max(F.transform(starts, lambda o: F.aggregate(F.slice(F.col("equal"), reach + 1 - o, length), F.lit(0), lambda a, x: a + x)))
    verified = hits.select("doc_id", "item_id", "p", "span", length.alias("length"), "item_words", equal.alias("equal")).select("doc_id", "item_id", "p", "span", (best / F.col("length")).alias("equal_share")).where(F.col("equal_share") >= share)
    return verified.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.min("p").cast("long").alias("first_token"), F.max(F.col("p") + F.col("span") - 1).cast("long").alias("last_token"), F.max("equal_share").alias("equal_share"))


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")), U.table(spark, sf_dir, "benchmark"))


def _seeds_sql(words: str, p: str, size: str | None = None) -> str:
    """(number of the run, text of the kept tokens) of each run that fits; size: the item's, which a whole run must have."""
    whole = range(SHORT, min(SPANS))
    each = []
    for k, kept in runs(tuple(whole)):
        fits = f"{p} + {kept[-1] + 1} <= len({words})" + (f" AND {size} = {-k}" if k < 0 and size else "")
        each.append(f"CASE WHEN {fits} THEN {{'seed': concat_ws(' ', '{k}', {', '.join(f'{words}[{p} + {o + 1}]' for o in kept)}), 'span': {kept[-1] + 1}}} END")
    return "[" + ", ".join(each) + "]"


def _oracle() -> str:
    split = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s!-/:-@\\[-`{-~]+'), lambda x: x <> '')"
    total = " + ".join(f"CASE WHEN p + {{s}} + {k} >= 0 AND q + {{s}} + {k} >= 0 AND {k} < n AND words[p + {{s}} + {k + 1}] = item_words[q + {{s}} + {k + 1}] THEN 1 ELSE 0 END" for k in range(WINDOW))
    best = ", ".join(f"CASE WHEN {o} <= greatest(n - {min(SPANS)}, 0) THEN {total.format(s=-o)} ELSE 0 END" for o in range(WINDOW - min(SPANS) + 1))
    return f"""
WITH items AS (SELECT DISTINCT item_id, {split} AS item_words, text FROM benchmark),
item_places AS (SELECT item_id, item_words, unnest(range(len(item_words) - {SHORT - 1})) AS q FROM items WHERE len(item_words) >= {SHORT}),
item_runs AS (SELECT item_id, item_words, q, unnest({_seeds_sql("item_words", "q", "len(item_words)")}) AS s FROM item_places),
item_seeds AS (SELECT item_id, item_words, q, s.seed AS seed FROM item_runs WHERE s IS NOT NULL),
wanted AS (SELECT DISTINCT seed FROM item_seeds),
texts AS (SELECT doc_id, {split} AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(len(words) - {SHORT - 1})) AS p FROM texts WHERE len(words) >= {SHORT}),
runs AS (SELECT doc_id, words, p, unnest({_seeds_sql("words", "p")}) AS s FROM places),
seeds AS (SELECT doc_id, words, p, s.seed AS seed, s.span AS span FROM runs WHERE s IS NOT NULL AND s.seed IN (SELECT seed FROM wanted)),
hits AS (SELECT doc_id, item_id, p, q, span, words, item_words, least({WINDOW}, len(item_words)) AS n FROM seeds JOIN item_seeds USING (seed)),
scored AS (SELECT doc_id, item_id, p, span, CAST(greatest({best}) AS DOUBLE) / n AS equal_share FROM hits)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(min(p) AS BIGINT) AS first_token, CAST(max(p + span - 1) AS BIGINT) AS last_token, max(equal_share) AS equal_share
FROM scored WHERE equal_share >= {SHARE} GROUP BY doc_id, item_id"""


ORACLE_SQL = {"op1_spaced_seed_decontamination": _oracle()}
