"""Finite-state graphs and grammars as arc tables.

Grammar text is small, so it is parsed where the job is planned; what comes out are arcs, which are a table from then on:
closure, silences, alternatives and export are jobs of `operators.graph`. States are numbered in the order of
the source text."""

from __future__ import annotations

import math
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import add_arcs, close_epsilon
from .lines import clean, numbered

ARC = "fsg string, from_state int, to_state int, logp double, word string"


def read_fsg(spark: SparkSession, path: str, lw: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(graphs, arcs): fsg, n_state, start, final; and the arcs with their epsilon closure.

    Short keywords are the long ones' first letters. Log weights are times lw, the language weight. A probability
    outside (0, 1], a line that isn't an arc, a header number that is missing, or a state out of range is an error. Graphs
    of one name in different files stay apart: each is named `file#name` where its name isn't unique."""
    lines = clean(numbered(spark, path)).withColumn("f", F.split("line", r"\s+"))
    by = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("f")[0].isin("NUM_STATES", "N"), "n_state").when(F.col("f")[0].isin("START_STATE", "S"), "start").when(F.col("f")[0].isin("FINAL_STATE", "F"), "final").when(F.col("f")[0].isin("TRANSITION", "T"), "arc")
    name = F.last(F.when(F.col("f")[0] == "FSG_BEGIN", F.coalesce(F.get("f", F.lit(1)), F.lit(""))), ignorenulls=True).over(by)
    rows = lines.select("file", name.alias("fsg"), key.alias("key"), "f").where("key is not null")
    number = lambda k: F.max(F.when(F.col("key") == k, F.expr("try_cast(f[1] as int)"))).alias(k)
    graphs = rows.groupBy("file", "fsg").agg(number("n_state"), number("start"), number("final"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("fsg")) > 1
    named = F.when(twice, F.concat_ws("#", F.regexp_extract("file", "([^/]*)$", 1), "fsg")).otherwise(F.col("fsg"))
    whole = (F.col("start") >= 0) & (F.col("start") < F.col("n_state")) & (F.col("final") >= 0) & (F.col("final") < F.col("n_state"))
    wrong = F.raise_error(F.concat(F.lit("a graph's states are missing or out of range: "), "fsg"))
    graphs = graphs.withColumn("n_state", F.when(whole, F.col("n_state")).otherwise(wrong.cast("int"))).withColumn("_name", named)
    state = lambda i: F.expr(f"try_cast(f[{i}] as int)")
    p = F.expr("try_cast(get(f, 3) as double)")
    inside = (state(1) >= 0) & (state(1) < F.col("n_state")) & (state(2) >= 0) & (state(2) < F.col("n_state")) & (p > 0) & (p <= 1)
    bad = F.raise_error(F.concat(F.lit("not an arc: "), F.array_join("f", " "))).cast("double")
    met = rows.where("key = 'arc'").join(graphs.select("file", "fsg", "n_state", "_name"), ["file", "fsg"])
    arcs = met.select(F.col("_name").alias("fsg"), state(1).alias("from_state"), state(2).alias("to_state"), F.when(inside, F.log(p) * lw).otherwise(bad).alias("logp"), F.get("f", F.lit(4)).alias("word"))
    return graphs.select(F.col("_name").alias("fsg"), "n_state", "start", "final"), close_epsilon(add_arcs(arcs))


@dataclass
class Item:
    """Of an alternative: a word, a rule's name (`<...>`) or a list of alternatives; how often, and its weight."""

    of: object
    repeat: str = ""
    weight: float = 1.0


@dataclass
class Grammar:
    """Rules by full name, in the order of definition; the first definition of a name counts."""

    name: str
    rules: dict[str, list[list[Item]]] = field(default_factory=dict)
    public: list[str] = field(default_factory=list)

    def full(self, name: str) -> str:
        return name if "." in name else f"<{self.name}.{name[1:]}"


_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|\{(?:\\.|[^}\\])*\}|(?P<t>/\s*[0-9.]+\s*/|<[^<>]+>|"(?:\\.|[^"\\])*"|[;=|()\[\]*+]|[^\s;=|()\[\]*+<>{}/"]+)', re.S)


def parse(text: str) -> tuple[Grammar, list[str]]:
    """The grammar and the names it imports."""
    text, at, tokens = re.sub(r"^\s*(?:/\*.*?\*/\s*)*#JSGF[^;]*;", "", text, flags=re.S), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a grammar near {text[at : at + 20]!r}")
        tokens += [m["t"]] if m["t"] else []
        at = m.end()
    place = 0

    def take(expected: str | None = None) -> str:
        nonlocal place
        if place >= len(tokens) or expected and tokens[place] != expected:
            raise ValueError(f"{expected or 'more'} expected after {' '.join(tokens[max(0, place - 4) : place])}")
        place += 1
        return tokens[place - 1]

    def alternatives(end: str) -> list[list[Item]]:
        out: list[list[Item]] = [[]]
        while (t := take()) != end:
            if t == "|":
                out.append([])
                continue
            weight = 1.0
            if t.startswith("/"):
                weight, t = float(t.strip("/ ")), take()
            if t in "([":
                item = Item(alternatives(")" if t == "(" else "]"), "?" if t == "[" else "", weight)
            elif t in ";=)]*+":
                raise ValueError(f"{t} isn't expected here")
            else:
                item = Item(re.sub(r"\\(.)", r"\1", t[1:-1]) if t[0] == '"' else t, "", weight)
            while place < len(tokens) and tokens[place] in "*+":
                item = Item([[item]], take(), weight) if item.repeat else Item(item.of, take(), weight)
            out[-1].append(item)
        if not all(out):
            raise ValueError("an alternative is empty")
        return out

    take("grammar")
    grammar, imports = Grammar(take()), []
    take(";")
    while place < len(tokens):
        t = take()
        if t == "import":
            imports.append(take())
            take(";")
            continue
        public = t == "public"
        name = grammar.full(take() if public else t)
        take("=")
        body = alternatives(";")
        if name not in grammar.rules:
            grammar.rules[name] = body
            grammar.public += [name] if public else []
    return grammar, imports


def load(spark: SparkSession, path: str, search: list[str] | None = None) -> Grammar:
    """The grammar of a file with the public rules that it imports: `<package.rule>` or `<package.*>`, from package.gram in
    the search folders, or in the file's own without any. Each file is read once."""
    folders, seen = search or [posixpath.dirname(path)], {}

    def text_of(file: str) -> str:
        return spark.read.text(file, wholetext=True).first()[0]

    def read(file: str) -> Grammar:
        if file not in seen:
            seen[file], imports = parse(text_of(file))
            for name in imports:
                package, _, rule = name.strip("<>").rpartition(".")
                other = None
                for f in folders:
                    try:
                        other = read(posixpath.join(f, package.replace(".", "/") + ".gram"))
                        break
                    except Exception as e:  # the next folder may have it
                        if "PATH_NOT_FOUND" not in str(e):
                            raise
                if other is None:
                    raise ValueError(f"no grammar for {name}")
                for full in other.public:
                    if rule in ("*", full.strip("<>").rpartition(".")[2]):
                        seen[file].rules.update({k: v for k, v in other.rules.items() if k not in seen[file].rules})
        return seen[file]

    return read(path)


def expand(grammar: Grammar, rule: str | None = None) -> tuple[int, int, list[tuple[int, int, float, str | None]]]:
    """(start, final, arcs) of a rule, the first public one by default; log weights.

    A rule inside itself is an arc back to its beginning, which is right only at the end of every alternative on the way, so
    elsewhere it is an error, as are undefined rules and <VOID>."""
    top = grammar.full(rule) if rule else next(iter(grammar.public), None)
    if top is None or top not in grammar.rules:
        raise ValueError("no such rule, or none is public")
    arcs: list[tuple[int, int, float, str | None]] = []
    states = 0
    entries: dict[str, int] = {}

    def new() -> int:
        nonlocal states
        states += 1
        return states - 1

    def element(item: Item, a: int, owner: str, last: bool) -> int:
        """Puts an item at state a and returns the state after it."""
        cost = math.log(item.weight) if item.weight > 0 else -math.inf
        if item.repeat:
            begin, end = new(), new()
            arcs.append((a, begin, cost, None))
            after = element(Item(item.of), begin, owner, last and item.repeat == "?")
            if after >= 0:
                arcs.append((after, end, 0.0, None))
                if item.repeat in "*+":
                    arcs.append((after, begin, 0.0, None))
            if item.repeat in "*?":
                arcs.append((begin, end, 0.0, None))
            return end
        if isinstance(item.of, list):
            end = new()
            for alt in item.of:
                sequence(alt, a, end, owner, last, cost)
            return end
        if item.of == "<NULL>":
            return a
        if item.of[0] != "<":
            b = new()
            arcs.append((a, b, cost, item.of))
            return b
        name = item.of if "." in item.of else f"{owner.rpartition('.')[0]}.{item.of[1:]}"
        if name not in grammar.rules or item.of == "<VOID>":
            raise ValueError(f"{name} can't be expanded")
        if name in entries:
            if not last:
                raise ValueError(f"{name} recurs other than at its end")
            arcs.append((a, entries[name], cost, None))
            return -1
        begin, end = new(), new()
        arcs.append((a, begin, cost, None))
        entries[name] = begin
        for alt in grammar.rules[name]:
            sequence(alt, begin, end, name, last, 0.0)
        del entries[name]
        return end

    def sequence(alt: list[Item], a: int, end: int, owner: str, last: bool, cost: float) -> None:
        if cost:
            b = new()
            arcs.append((a, b, cost, None))
            a = b
        for i, item in enumerate(alt):
            a = element(item, a, owner, last and i == len(alt) - 1)
            if a < 0:
                return
        arcs.append((a, end, 0.0, None))

    start = new()
    final = element(Item(top), start, top, True)
    return start, final, arcs


def grammar_arcs(spark: SparkSession, grammar: Grammar, rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(graphs, arcs) of a rule, as read_fsg gives them."""
    start, final, arcs = expand(grammar, rule)
    name = grammar.full(rule) if rule else grammar.public[0]
    n = max(max(a, b) for a, b, _, _ in arcs) + 1
    table = spark.createDataFrame([(name, a, b, p, w) for a, b, p, w in arcs], ARC)
    return spark.createDataFrame([(name, n, start, final)], "fsg string, n_state int, start int, final int"), add_arcs(table)
