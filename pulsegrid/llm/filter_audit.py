"""Filter interaction audit by folds in higher-order SQL functions (operator 13).

A document is reduced to a mask, one bit for each filter that it fails. Documents of a part with equal
masks are one cell. Each cell folds across the array of all filter orders: `transform` over the
orders, `aggregate` along each, which gives orders x filters structs weighted by the cell's
counts. The cells of a part are merged by elementwise sums.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
NULL_SPREAD = 1024  # documents without id join no label; they are dealt over so many keys


def text_failures(text: Column, min_words: int = 200, distinct_percent: int = 50,
                  capital_percent: int = 2, marks: str = "#$%&*|") -> Column:
    """The bits of the filters on one text: A 1 (few words), B 2 (few distinct words), C 4 (many
    capitals), D 8 (a mark)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(counts: Column) -> Column:
        n, distinct = counts["n"].cast("long"), counts["distinct"].cast("long")
        fails = [n < min_words, 100 * distinct < distinct_percent * n,
                 100 * capitals.cast("long") > capital_percent * F.length(text).cast("long"),
                 text.rlike(f"[{marks}]")]
        return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))

    # transform over one element binds what is used twice, so that words are split once
    counted = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return F.element_at(F.transform(counted, bits), 1)


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source", **limits: int) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and the filters that they fail, E (16) being a copy.

    A text leaves its task only as its SHA-256. Rows are counted by (id, digest, part, mask) before
    each shuffle, so of a large group of copies each task sends on a few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text, **limits).alias("mask"))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SPREAD))).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("spread")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = rows.groupBy("id", "spread", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marked = counted.join(marks, ["id", "spread"], "left").na.fill(0, ["good", "toxic"])
    copies = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    # Cells of one text: at most parts x labels. All but those of the smallest id fail E.
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    fresh = F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0)
    return (copies.withColumn("fresh", fresh)
            .select("part", "good", "toxic", F.explode(F.array(
                F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
                F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("cell"))
            .groupBy("part", "cell.mask")
            .agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"),
                 F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic")))


def all_orders(filters: str = FILTERS) -> list[str]:
    return ["".join(order) for order in permutations(filters)]


def fold_orders(orders: list[str], filters: str = FILTERS) -> Column:
    """What each step of each order does to a cell (mask, n, good, toxic): an array of structs.

    `aggregate` walks an order with the filters applied so far; a document is there as long as its
    mask has none of them.
    """
    bit = " ".join(f"WHEN '{f}' THEN {1 << k}" for k, f in enumerate(filters))
    step = """named_struct('filter_order', o, 'step', i, 'filter', substring(o, i, 1),
        'kept', if((acc.past | b) & mask = 0, n, 0L),
        'removed', if(acc.past & mask = 0 AND mask & b <> 0, n, 0L),
        'redundant', if(acc.past & mask <> 0 AND mask & b <> 0, n, 0L),
        'unique_fails', if(mask = b, n, 0L),
        'good_lost', if(acc.past & mask = 0 AND mask & b <> 0, good, 0L),
        'toxic_lost', if(acc.past & mask = 0 AND mask & b <> 0, toxic, 0L))"""
    kinds = "filter_order:string,step:int,filter:string," + ",".join(f"{c}:bigint" for c in COUNTS)
    quoted = ", ".join(f"'{o}'" for o in orders)
    return F.expr(f"""
        flatten(transform(array({quoted}), o -> aggregate(sequence(1, {len(filters)}),
            named_struct('past', 0, 'steps', CAST(array() AS array<struct<{kinds}>>)),
            (acc, i) -> transform(array(CASE substring(o, i, 1) {bit} END), b -> named_struct(
                'past', acc.past | b, 'steps', concat(acc.steps, array({step}))))[0],
            acc -> acc.steps)))""")


def merge_cells(folded: str) -> Column:
    """Elementwise sums over the cells of a part, in a fold over their arrays."""
    sums = ", ".join(f"'{c}', a.{c} + b.{c}" for c in COUNTS)
    return F.expr(f"""
        aggregate(slice({folded}, 2, size({folded})), {folded}[0], (acc, x) -> zip_with(acc, x, (a, b) ->
            named_struct('filter_order', a.filter_order, 'step', a.step, 'filter', a.filter, {sums})))""")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source", **limits: int) -> DataFrame:
    """What each filter removes at each step of each order of the filters, per part.

    Filters: A under `min_words` words, B fewer than `distinct_percent` per cent distinct words, C more than
    `capital_percent` per cent capitals, D one of `marks`, E a text that a smaller id has too. Returns
    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley: a filter's removed, summed over all orders. 600 rows per part.

    A null text is empty, a null part the empty string. A null id is no smaller and no larger than any, so
    it fails no E, and has no label. Rows that repeat an id count each; those with the smallest id
    of a text all pass E. An id with several labels is good, or toxic, if any says so. Other columns
    are ignored. An empty table has no parts.

    A part has at most 32 cells, so one row folds 32 arrays of 600 structs whatever the input.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col, **limits)
    merged = (cells.select("part", fold_orders(all_orders()).alias("steps"))
              .groupBy("part").agg(F.collect_list("steps").alias("cells"))
              .select("part", merge_cells("cells").alias("steps")))
    shapley = F.expr("map_from_arrays(array({0}), transform(array({0}), f -> aggregate(steps, 0L, "
                     "(acc, s) -> acc + if(s.filter = f, s.removed, 0L))))".format(", ".join(f"'{f}'" for f in FILTERS)))
    return (merged.select("part", shapley.alias("shapley"), F.explode("steps").alias("s"))
            .select("part", "s.*", F.element_at("shapley", F.col("s.filter")).alias("shapley")))
