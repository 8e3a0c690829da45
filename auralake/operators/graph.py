"""Weighted finite-state graphs as tables of arcs (fsg, from_state, to_state, logp, word); a null word is an epsilon arc.

Of arcs with the same ends and word the likeliest stays. Epsilon closure joins changed arcs with all arcs on both sides, so
it takes about the logarithm of the longest path in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import new_folder, stored

ENDS = ["fsg", "from_state", "to_state"]


def add_arcs(arcs: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The arcs of both, each (ends, word) once with its greatest log probability; epsilon loops go, and an arc with a
    probability above one is an error."""
    every = arcs if new is None else arcs.unionByName(new)
    checked = every.withColumn("logp", F.when(F.col("logp") > 0, F.raise_error(F.lit("an arc's probability is above one")).cast("double")).otherwise(F.col("logp")))
    kept = checked.where("word is not null or from_state <> to_state")
    return kept.groupBy(*ENDS, "word").agg(F.max("logp").alias("logp")).select(*ENDS, "logp", "word")


def close_epsilon(arcs: DataFrame, rounds: int = 64, seen: list[int] | None = None) -> DataFrame:
    """arcs with all compositions of epsilon arcs, each pair of states once with the likeliest path. Composing arcs of
    probability one at most never improves a cycle, so the rounds end on cyclic graphs as well: with the first one that finds
    no new or better arc anywhere.

    A round composes only what the last one changed, in front of and behind all arcs: two arcs that were both there unchanged met
    in the round that the later one came. seen, if given, gets the number of changed arcs of each round."""
    spark = arcs.sparkSession
    folder = new_folder(spark, "closure")
    own = stored(add_arcs(arcs.where("word is null")).select(*ENDS, "logp", F.lit(True).alias("_new")), f"{folder}/0")
    for i in range(rounds):
        n = own.where("_new").count()
        if seen is not None:
            seen.append(n)
        if not n:
            break
        front = lambda rows: rows.select("fsg", "from_state", F.col("to_state").alias("_mid"), F.col("logp").alias("_x"), F.col("_new").alias("_xn"))
        back = lambda rows: rows.select("fsg", F.col("from_state").alias("_mid"), "to_state", F.col("logp").alias("_y"))
        new = own.where("_new")
        after = front(new).join(back(own), ["fsg", "_mid"])
        before = front(own).where("not _xn").join(back(new), ["fsg", "_mid"])
        paths = after.union(before).where("from_state <> to_state").select(*ENDS, (F.col("_x") + F.col("_y")).alias("logp"), F.lit(None).cast("double").alias("_had"))
        both = own.select(*ENDS, "logp", F.col("logp").alias("_had")).union(paths).groupBy(*ENDS).agg(F.max("logp").alias("logp"), F.max("_had").alias("_had"))
        # a path counts as better from the last digits on, so that sums in another order aren't news
        better = F.col("_had").isNull() | (F.col("logp") > F.col("_had") + F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs("_had")))
        own = stored(both.select(*ENDS, "logp", better.alias("_new")), f"{folder}/{i + 1}")
    else:
        raise RuntimeError(f"the closure didn't settle in {rounds} rounds")
    return arcs.where("word is not null").select(*ENDS, "logp", "word").union(own.select(*ENDS, "logp", F.lit(None).cast("string").alias("word")))


def states(arcs: DataFrame) -> DataFrame:
    return arcs.select("fsg", F.col("from_state").alias("state")).union(arcs.select("fsg", "to_state")).distinct()


def add_silence(arcs: DataFrame, logp: float, word: str = "<sil>", state: int | None = None) -> DataFrame:
    """A loop of the filler word at every state, or at one."""
    at = states(arcs)
    at = at if state is None else at.where(F.col("state") == state)
    return add_arcs(arcs, at.select("fsg", F.col("state").alias("from_state"), F.col("state").alias("to_state"), F.lit(float(logp)).alias("logp"), F.lit(word).alias("word")))


def add_alternative(arcs: DataFrame, word: str, alternative: str) -> DataFrame:
    """Every arc of the word doubled for its alternative."""
    return add_arcs(arcs, arcs.where(F.col("word") == word).withColumn("word", F.lit(alternative)))


def between(arcs: DataFrame, source: int, target: int, epsilon: bool = False) -> DataFrame:
    return arcs.where((F.col("from_state") == source) & (F.col("to_state") == target) & (F.col("word").isNull() if epsilon else F.col("word").isNotNull()))


def leaving(arcs: DataFrame, state: int) -> DataFrame:
    """Arcs out of a state, words before epsilons."""
    return arcs.where(F.col("from_state") == state).orderBy(F.col("word").isNull(), "to_state", "word")


def vocabulary(arcs: DataFrame) -> DataFrame:
    """(fsg, wid, word), numbered within each graph by first use: by state, then target."""
    first = arcs.where("word is not null").groupBy("fsg", "word").agg(F.min(F.struct("from_state", "to_state")).alias("_f"))
    return first.select("fsg", (F.row_number().over(Window.partitionBy("fsg").orderBy("_f", "word")) - 1).alias("wid"), "word")


def fsg_lines(arcs: DataFrame, start: int, final: int, lw: float = 1.0) -> DataFrame:
    """(fsg, line_no, line): the text form, word arcs before epsilon arcs of each state."""
    body = arcs.select("fsg", F.struct(F.col("from_state").alias("a"), F.col("word").isNull().alias("e"), F.col("to_state").alias("b"), F.col("word").alias("w")).alias("o"), F.format_string("TRANSITION %d %d %f %s", "from_state", "to_state", F.exp(F.col("logp") / lw), F.coalesce("word", F.lit(""))).alias("line"))
    head = states(arcs).groupBy("fsg").agg(F.max("state").alias("m"))
    lines = head.select("fsg", F.posexplode(F.array(F.concat(F.lit("FSG_BEGIN "), "fsg"), F.concat(F.lit("NUM_STATES "), (F.col("m") + 1).cast("string")), F.lit(f"START_STATE {start}"), F.lit(f"FINAL_STATE {final}"))).alias("line_no", "line"))
    n = Window.partitionBy("fsg").orderBy("o")
    numbered = body.select("fsg", (F.row_number().over(n) + 3).alias("line_no"), F.rtrim("line").alias("line"))
    count = arcs.groupBy("fsg").agg(F.count(F.lit(1)).alias("n")).select("fsg", (F.col("n") + 4).alias("line_no"), F.lit("FSG_END").alias("line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long")).union(numbered.withColumn("line_no", F.col("line_no").cast("long"))).union(count)


def fsm_lines(arcs: DataFrame, start: int, final: int) -> DataFrame:
    """(fsg, line_no, line): the text form of finite-state toolkits, the start state's arcs first, costs as -ln p."""
    n = Window.partitionBy("fsg").orderBy(F.col("from_state") != start, "from_state", F.col("word").isNull(), "to_state", "word")
    body = arcs.select("fsg", F.row_number().over(n).cast("long").alias("line_no"), F.format_string("%d %d %s %f", "from_state", "to_state", F.coalesce("word", F.lit("<eps>")), -F.col("logp")).alias("line"))
    end = arcs.groupBy("fsg").agg((F.count(F.lit(1)) + 1).alias("line_no")).select("fsg", "line_no", F.lit(f"{final} 0").alias("line"))
    return body.union(end)


def symbol_lines(arcs: DataFrame) -> DataFrame:
    """(fsg, line_no, line): the symbols, epsilon as 0."""
    words = vocabulary(arcs).select("fsg", (F.col("wid") + 1).cast("long").alias("line_no"), F.concat_ws(" ", "word", (F.col("wid") + 1).cast("string")).alias("line"))
    return words.union(arcs.select("fsg").distinct().select("fsg", F.lit(0).cast("long"), F.lit("<eps> 0")))
