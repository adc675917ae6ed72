"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs (lines, cut every PIECE characters, its opening more finely) are hashed, a repeated one together with
its number among its equals; each digest goes into one cell of each of three sub-tables, and a cell holds the count, the
xor of its digests and the xor of their checks.  Subtracting two sketches cell by cell cancels what the texts share.
Peeling then takes digests out of cells that hold just one, round by round, and so lists the digests that differ; a
sketch that doesn't come empty is tried again larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.llm import common

#: Characters of a piece of a line, and of one in a text's first OPENING characters, so that short texts have several.
PIECE, SHORT, OPENING = 120, 24, 240
#: Cells of a sub-table of a fingerprint, and peeling rounds, three of which go once through all cells.
CELLS, ROUNDS = 64, 9
#: Kinds of differences: to the edited text, to the next text.
BY_EDIT, BY_NEXT = range(2)
#: Digests of texts that a task takes, about: each fills some nine cells, of some 200 bytes of aggregation memory.
TASK_DIGESTS = 100_000
_CHECK = 0xFFFFFFFF
#: Steps back to the first of equal digests: a run of up to 2**31 is halved.
_STEPS = [1 << k for k in range(30, -1, -1)]


def pieces(text: Column) -> Column:
    """The hashes of a text's pieces in ascending order."""
    cut = lambda t, n: F.regexp_extract_all(t, F.lit("[^\\n]{1,%d}" % n), F.lit(0))
    both = F.concat(cut(F.substr(text, F.lit(1), F.lit(OPENING)), SHORT), cut(F.substr(text, F.lit(OPENING + 1)), PIECE))
    return F.sort_array(F.transform(both, lambda x: F.xxhash64(x)))


def numbered(hashes: Column) -> Column:
    """Digests from ascending hashes: the first of equal ones as it is, the others hashed with their number.  `hashes` has to be a column."""

    def digest(x: Column, i: Column) -> Column:
        back = lambda at, step: F.when((at >= step) & (F.get(hashes, at - step) == x), at - step).otherwise(at)
        first = F.aggregate(F.array(*[F.lit(k) for k in _STEPS]), i, back)
        return F.when((i > 0) & (F.get(hashes, i - 1) == x), F.xxhash64(x, i - first)).otherwise(x)

    return F.transform(hashes, digest)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(_CHECK))


def _cell(key: Column, j: int, m: Column) -> Column:
    return j * m + F.pmod(F.xxhash64(key, F.lit(j)), m)


def _power(n: Column) -> Column:
    """The least power of two that isn't below n."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def _marked(digests: str, side: int) -> Column:
    return F.transform(digests, lambda x: F.struct(x.alias("key"), F.lit(side).alias("side")))


def sketches(sets: DataFrame, sides: list[str], m: Column | None = None) -> DataFrame:
    """uid, m, cell and, for the k-th of the digest columns `sides` of sets(uid, ..), cnt<k>, key<k> and chk<k>: the sketches side by side.

    CELLS cells a sub-table unless m gives their number; cells that are empty in all sketches are left out.
    """
    marked = F.concat(*[_marked(c, k) for k, c in enumerate(sides)])
    each = sets.select("uid", (F.lit(CELLS).cast("long") if m is None else m).alias("m"), F.explode(marked).alias("e")).select("uid", "m", "e.key", "e.side")
    cells = F.array(*[_cell(F.col("key"), j, F.col("m")) for j in range(3)])
    rows = each.select("uid", "m", "key", "side", _check(F.col("key")).alias("chk"), F.explode(cells).alias("cell"))
    aggs = []
    for k in range(len(sides)):
        own = F.col("side") == k
        aggs += [F.count(F.when(own, 1)).alias(f"cnt{k}"), F.bit_xor(F.when(own, F.col("key")).otherwise(0)).alias(f"key{k}"), F.bit_xor(F.when(own, F.col("chk")).otherwise(0)).alias(f"chk{k}")]
    return rows.groupBy("uid", "m", "cell").agg(*aggs)


def subtracted(cells: DataFrame) -> DataFrame:
    """uid, kind, m, cell, cnt, key, chk: the first of three sketches less the second (BY_EDIT) and less the third (BY_NEXT); empty cells go."""
    less = lambda kind, k: F.struct(F.lit(kind).alias("kind"), (F.col("cnt0") - F.col(f"cnt{k}")).alias("cnt"), F.col("key0").bitwiseXOR(F.col(f"key{k}")).alias("key"), F.col("chk0").bitwiseXOR(F.col(f"chk{k}")).alias("chk"))
    return cells.select("uid", "m", "cell", F.explode(F.array(less(BY_EDIT, 1), less(BY_NEXT, 2))).alias("d")).select("uid", "d.kind", "m", "cell", "d.cnt", "d.key", "d.chk").filter("cnt <> 0 or key <> 0 or chk <> 0")


def _summed(rows: DataFrame) -> DataFrame:
    total = rows.groupBy("uid", "kind", "m", "cell").agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return total.filter("cnt <> 0 or key <> 0 or chk <> 0")


def peeled(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The cells after so many rounds; cell -1 counts the digests that were taken out.

    A cell with count 1 or -1 whose check fits its digest gives that digest up; the digest leaves its three cells.  The
    sub-tables take turns, so that no digest is given up twice in a round.
    """
    for k in range(rounds):
        key, m, j = F.col("key"), F.col("m"), k % 3
        pure = (F.abs("cnt") == 1) & (F.col("cell") >= j * m) & (F.col("cell") < (j + 1) * m) & (F.col("chk") == _check(key))
        row = lambda cell, cnt, key, chk: F.struct(cell.alias("cell"), cnt.alias("cnt"), key.alias("key"), chk.alias("chk"))
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        rest = row(F.col("cell"), F.col("cnt"), key, F.col("chk"))
        # the cell itself comes empty; the other two lose the digest
        others = [row(_cell(key, i, m), -F.col("cnt"), key, F.col("chk")) for i in range(3) if i != j]
        moved = cells.select("uid", "kind", "m", F.explode(F.when(pure, F.array(*others, row(F.lit(-1).cast("long"), one, zero, zero))).otherwise(F.array(rest))).alias("t"))
        cells = _summed(moved.select("uid", "kind", "m", "t.*"))
    return cells


def differences(sets: DataFrame, larger: int = 0) -> DataFrame:
    """uid, by_edit and by_next of sets(uid, own, edited, next): how many digests differ; null where the sketch didn't come empty.

    larger: 0 for sketches of CELLS cells a sub-table, else at least so many cells for each digest of the larger text.
    """
    most = F.greatest(F.size("own"), F.size("edited"), F.size("next"))
    m = _power(F.greatest(F.lit(2 * CELLS), larger * most)) if larger else None
    cells = peeled(subtracted(sketches(sets, ["own", "edited", "next"], m)))
    aggs = []
    for kind in (BY_EDIT, BY_NEXT):
        mine = F.col("kind") == kind
        aggs += [F.coalesce(F.sum(F.when(mine & (F.col("cell") == -1), F.col("cnt"))), F.lit(0)).alias(f"d{kind}"), F.count(F.when(mine & (F.col("cell") >= 0), 1)).alias(f"left{kind}")]
    pick = lambda k: F.when(F.col(f"left{k}") == 0, F.col(f"d{k}"))
    return cells.groupBy("uid").agg(*aggs).select("uid", pick(BY_EDIT).alias("by_edit"), pick(BY_NEXT).alias("by_next"))


def written(sets: DataFrame) -> DataFrame:
    """uid, fingerprint and edited_fingerprint of sets(uid, own, edited): the cells as text, in cell order."""
    cells = sketches(sets.select("uid", "own", "edited"), ["own", "edited"])
    part = lambda k: F.sort_array(F.collect_list(F.when(F.col(f"cnt{k}") > 0, F.struct("cell", f"cnt{k}", f"key{k}", f"chk{k}"))))
    text = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat_ws(".", x["cell"].cast("string"), x[f"cnt{k}"].cast("string"), F.lower(F.hex(x[f"key{k}"])), F.lower(F.hex(x[f"chk{k}"])))), " ")
    both = cells.groupBy("uid").agg(part(0).alias("a"), part(1).alias("b"))
    return both.select("uid", text("a", 0).alias("fingerprint"), text("b", 1).alias("edited_fingerprint"))


def successors(ids: DataFrame) -> DataFrame:
    """uid and next_uid of ids(uid, doc_id, ..): the next row by descending doc_id (nulls last, then uid); after the last the first.

    The rows are dealt out by ranges of the order; neighbours across ranges come from one row a range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("uid").asc()]
    cut = common.stored(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "order")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.bitwise_not("doc_id").alias("back"), "uid"))["uid"]
    heads = cut.groupBy("range").agg(first.alias("head"))
    over = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inner = cut.withColumn("next_uid", F.lead("uid").over(Window.partitionBy("range").orderBy(*order)))
    return inner.join(heads, "range").withColumn("next_uid", F.coalesce("next_uid", "after")).drop("range", "after")


def _dealt(sets: DataFrame) -> DataFrame:
    """sets by uid, in so many tasks that none gets many more than TASK_DIGESTS digests of texts."""
    total = sets.agg(F.sum(F.size("own"))).first()[0] or 0
    return sets.repartition(max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DIGESTS)), "uid")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, with likenesses; a row for each row.

    The edited text ends in the beginning of the next document (see successors): its last third of code points is
    replaced.  A likeness is the share of digests that two texts have in common (Dice); two texts without digests are
    alike (1).  A null text is an empty one; repeated rows follow one another, ties in the order of files and rows; an
    empty table gives no rows; further columns are passed over.
    """
    spark, drop = docs.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        drop.append(common.new_path(spark, tag))
        return common.stored(df, tag, drop[-1])

    rows = common.with_row_id(common.steady(docs).select("doc_id", "text"), "uid")
    text = rows.select("uid", F.coalesce("text", F.lit("")).alias("text"))
    ids = common.stored(successors(rows.select("uid", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))), "successors")
    wanted = ids.select(F.col("next_uid").alias("uid"), F.col("uid").alias("before"), F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    # both sides of the next join read one shuffle of the texts
    lent = text.join(wanted.hint("shuffle_hash"), "uid").select(F.col("before").alias("uid"), F.col("uid").alias("next_uid"), F.substr("text", F.lit(1), F.col("k")).alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    met = text.join(lent.hint("shuffle_hash"), "uid").select("uid", "next_uid", "text", edited.alias("edited"))
    hashed = met.select("uid", "next_uid", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), pieces(F.col("text")).alias("a"), pieces(F.col("edited")).alias("b"))
    sets = common.stored(hashed.select("uid", "next_uid", "edited_sha256", numbered(F.col("a")).alias("own"), numbered(F.col("b")).alias("edited")), "digests")
    following = sets.select(F.col("uid").alias("next_uid"), F.col("own").alias("next"))
    beside = kept(sets.select("uid", "next_uid", "own", "edited").join(following, "next_uid").select("uid", "own", "edited", "next"), "beside")
    larger, open_ = 2, F.col("by_edit").isNull() | F.col("by_next").isNull()
    found = kept(differences(_dealt(beside)), "differences")
    while (rest := kept(beside.join(found.filter(open_).select("uid").hint("shuffle_hash"), "uid", "left_semi"), "undecided")).limit(1).count():
        larger *= 2
        again = differences(_dealt(rest), larger).withColumnsRenamed({"by_edit": "e", "by_next": "x"})
        found = kept(found.join(again, "uid", "left").select("uid", F.coalesce("by_edit", "e").alias("by_edit"), F.coalesce("by_next", "x").alias("by_next")), "differences")
    sizes = beside.select("uid", F.size("own").alias("own_n"), F.size("edited").alias("edited_n"), F.size("next").alias("next_n"))
    told = ids.select("uid", "doc_id", "n_chars").join(sets.select("uid", "edited_sha256"), "uid").join(sizes, "uid").join(found, "uid", "left")
    like = lambda d, n: F.when(n == 0, F.lit(1.0)).otherwise((n - F.coalesce(d, F.lit(0))) / n)
    told = common.stored(told.select(
        "uid", "doc_id", "n_chars", "edited_sha256", like(F.col("by_edit"), F.col("own_n") + F.col("edited_n")).alias("near_edited"), like(F.col("by_next"), F.col("own_n") + F.col("next_n")).alias("near_next"),
    ), "likenesses")
    for path in drop:
        common.drop_path(spark, path)
    return told.join(written(_dealt(sets.select("uid", "own", "edited"))).hint("merge"), "uid", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
