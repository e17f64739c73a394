"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every document of a source has the same expected number of copies. Its fractional part is a mass
in words: two documents at a time pass mass at random, one way or the other with
the odds that keep every expectation, until one of the two has a whole number of copies; the
other one goes on. Residuals are combined in blocks, level by level, until one per source is left.
All of it is DataFrame code.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.ordered import ordered_index
from pulsegrid.session import stored

WORDS = r"[^\x20\x09-\x0D]+"
RUN = 65_536  # equal rows are numbered in runs of so many, as a sequence is one array
NEAR = 1e-9  # a fraction this close to 0 or 1 is taken for it
ITEM = "struct<h:bigint,id:{id},k:int,size:bigint,p:double>"


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """id, source, size: the words of each whole text, 0 for null."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def counted(sized: DataFrame) -> DataFrame:
    """Rows that agree in id, source and size as one, with their number `rows`."""
    return sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))


def share_targets(sized: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """Words each source gives, out of counted rows: source, n, source_size, target.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes; a
    target stops at `cap` times its source. Ordered by cap per weight, the first source whose
    fair share of what is left fits its cap sets the level for itself and all after it. The
    windows run over one row per source.
    """
    stats = sized.groupBy("source").agg(F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (number % len(weights)).cast("int") + 1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = (stats.withColumn("weight", weight)
            .withColumn("cap", cap * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("rank", F.row_number().over(by_ratio))
            .withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
            .withColumn("level", F.col("left") / F.col("open")))
    fits = F.when(F.col("level") <= F.col("ratio") * (1 + NEAR), F.struct("rank", "level"))
    return (rows.withColumn("level", F.min(fits).over(whole)["level"])
            .select("source", "n", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def _fold(id_type: str) -> Column:
    """The documents of a block after pairing them one by one; an open one is last.

    a is the residual so far, x the next document. Mass moves up to a or down from it; the
    odds make up for the amounts, so each one's expected copies stay, and so does the sum of words.
    """
    item = ITEM.format(id=id_type)
    a = "element_at(acc, -1)"
    is_open = f"{a}.p > 0D AND {a}.p < 1D"
    up = f"least({a}.size * (1D - {a}.p), x.size * x.p)"
    down = f"least({a}.size * {a}.p, x.size * (1D - x.p))"
    draw = f"pmod(xxhash64({a}.h, x.h, 'draw'), 2147483647L) / 2147483647D"

    def near(value: str) -> str:
        return f"transform(array({value}), v -> CASE WHEN v < {NEAR}D THEN 0D WHEN v > 1D - {NEAR}D THEN 1D ELSE v END)[0]"

    def moved(up_sign: str, down_sign: str) -> str:
        """Both documents with their new fractions, the open one last."""
        pair = (f"named_struct('a', {near(f'{a}.p {up_sign} m / {a}.size')}, 'x', {near(f'x.p {down_sign} m / x.size')})")
        new_a = f"named_struct('h', {a}.h, 'id', {a}.id, 'k', {a}.k, 'size', {a}.size, 'p', q.a)"
        new_x = "named_struct('h', x.h, 'id', x.id, 'k', x.k, 'size', x.size, 'p', q.x)"
        return (f"transform(array({pair}), q -> CASE WHEN q.a > 0D AND q.a < 1D THEN array({new_x}, {new_a}) "
                f"ELSE array({new_a}, {new_x}) END)[0]")

    go_up = f"transform(array({up}), m -> {moved('+', '-')})[0]"
    go_down = f"transform(array({down}), m -> {moved('-', '+')})[0]"
    return F.expr(f"""
        aggregate(items, CAST(array() AS array<{item}>), (acc, x) -> CASE
            WHEN size(acc) = 0 THEN CAST(array(x) AS array<{item}>)
            WHEN NOT ({is_open}) THEN CAST(concat(acc, array(x)) AS array<{item}>)
            ELSE CAST(concat(slice(acc, 1, size(acc) - 1),
                 CASE WHEN ({draw}) * ({up} + {down}) < {down} THEN {go_up} ELSE {go_down} END) AS array<{item}>)
            END)""")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1),
        seed: int = 11, block: int = 64, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> DataFrame:
    """How much of every document the mix takes.

    Returns id_col, source, size, source_size, target, copies, taken; other columns are not kept.
    `copies` is whole, but for at most one document of each source, whose fraction is what meets
    the target; `taken` is size times copies, rounded. No document has over `cap` copies. The
    words taken of a source differ from its target by rounding alone. Draws are hashes of seed,
    id and size, so reruns agree.

    A null text has size 0 and is taken whole or not at all, at no cost; a null source is the
    last source. Rows that agree in id, source and size are counted before they are shuffled and then
    numbered, and the number is part of the draw, so they spread over blocks like others, however many;
    so do rows without id. A hot source is many blocks of about
    `block` rows, and one row of each goes on to the next level.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sized = stored(counted(sizes(docs, id_col, source_col, text_col)), "mix-sizes")
    targets = stored(share_targets(sized, share, cap, weights), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + NEAR).cast("double")
    fraction = F.greatest(rate - base, F.lit(0.0))
    rows = (sized.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
            .drop("own").withColumn("base", base)
            .withColumn("run", F.explode(F.sequence(F.lit(0), ((F.col("rows") - 1) / RUN).cast("int"))))
            .withColumn("k", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("rows", (F.col("run") + 1) * RUN).cast("int"))))
            .withColumn("p", F.when((fraction > NEAR) & (F.col("size") > 0), fraction).otherwise(0.0)))
    keys = ["source", "source_size", "target", "base"]
    done = [rows.where("p = 0").select("id", *keys, "size", "p")]
    still = rows.where("p > 0").select("id", *keys, "k", "size", "p", "n")
    most = targets.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        most = -(-most // block)
        dealt = (still.withColumn("n", F.ceil(F.col("n") / block))
                 .withColumn("h", F.xxhash64(F.lit(seed), F.lit(level), "source", "id", "size", "k"))
                 .withColumn("block", F.pmod("h", F.greatest("n", F.lit(1)))))
        folded = (dealt.groupBy(*keys, "n", "block")
                  .agg(F.array_sort(F.collect_list(F.struct("h", "id", "k", "size", "p"))).alias("items"))
                  .select(*keys, "n", F.explode(_fold(id_type)).alias("item"))
                  .select("item.id", *keys, "item.k", "item.size", "item.p", "n"))
        table = stored(folded, f"mix-level-{level}")
        whole = "p = 0 OR p = 1"
        level += 1
        if most <= 1:
            done.append(table.drop("n", "k"))
            break
        done.append(table.where(whole).drop("n", "k"))
        still = table.where(f"NOT ({whole})")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("base") + F.col("p")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target",
        copies.alias("copies"), F.round(F.col("size") * copies).cast("long").alias("taken"))


def take_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text") -> DataFrame:
    """The rows of the mix, with the documents' columns: each as often as it has copies.

    The one fractional document of a source is rounded to the nearest. Rows that agree in id,
    source and size share out their copies among them.
    """
    def key(ident: str, source: str, size: Column) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in (ident, source)]
        return F.concat_ws("\x00", *parts, size.cast("string"))

    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0))
    held = stored(mixed.select(key(id_col, "source", F.col("size")).alias("_mix_key"), F.round("copies").cast("int").alias("_mix_copies"))
                  .groupBy("_mix_key", "_mix_copies").agg(F.count("*").alias("n"))
                  .groupBy("_mix_key").agg(F.sum("n").alias("_mix_n"), F.array_sort(F.collect_list(F.struct(
                      F.col("_mix_copies").alias("copies"), "n"))).alias("_mix_held")), "mix-copies")
    # it grows with the documents, so it is merged and never broadcast
    taken = held.where("exists(_mix_held, h -> h.copies > 0)").hint("merge")
    keyed = docs.withColumn("_mix_key", key(id_col, source_col, size))
    alone = keyed.join(taken.where("_mix_n = 1"), "_mix_key").withColumn("_mix_copies", F.col("_mix_held")[0]["copies"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = alone.select(*columns, "_mix_copies")
    if not taken.where("_mix_n > 1").isEmpty():
        # rows that agree take the copies of their key by rank, in pieces of a range, as there may be any number of them
        several = keyed.join(taken.where("_mix_n > 1"), "_mix_key")
        several = stored(several.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-several")
        ranked = ordered_index(several, ["_mix_key"], [F.xxhash64(text_col), F.col("_mix_row")], "_mix_rank")
        own = F.expr("aggregate(_mix_held, struct(_mix_rank AS r, -1 AS c), (a, h) -> struct("
                     "a.r - h.n AS r, if(a.c < 0 AND a.r < h.n, h.copies, a.c) AS c), a -> a.c)")
        out = out.unionByName(ranked.withColumn("_mix_copies", own).select(*columns, "_mix_copies"))
    return (out.where("_mix_copies > 0").withColumn("_mix_copies", F.explode(F.sequence(F.lit(1), "_mix_copies")))
            .select(*columns))
