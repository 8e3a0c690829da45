import math
import re

import pytest

from auralake.operators import graph
from auralake.sources import graphs, lines

FSG = """# a graph
FSG_BEGIN g
N 4
S 0
F 3
T 0 1 1.0 go
T 0 1 0.5 go
TRANSITION 1 2 0.5
T 2 3 0.25
T 2 1 1.0
T 3 3 0.5
T 1 3 0.1 one
FSG_END
"""


@pytest.fixture(scope="module")
def arcs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "g.fsg"
    path.write_text(FSG)
    g, a = graphs.read_fsg(spark, str(path))
    assert tuple(g.first()) == ("g", 4, 0, 3)
    return a.cache()


def table(df):
    return {(r.from_state, r.to_state, r.word): r.logp for r in df.collect()}


def test_reading_keeps_the_best_and_drops_epsilon_loops(arcs):
    t = table(arcs)
    assert t[0, 1, "go"] == 0 and (3, 3, None) not in t and len(t) == 6
    assert t[1, 3, None] == pytest.approx(math.log(0.125))  # closed as it is read


def test_reading_refuses_what_is_out_of_range(spark, tmp_path):
    for i, (line, head) in enumerate([("T 0 4 0.5 go", "N 4"), ("T -1 1 0.5 go", "N 4"), ("T 0 1 1.5 go", "N 4"), ("T 0 x 0.5 go", "N 4"), ("T 0 1 0.5 go", "N 3"), ("T 0 1", "N 4")]):
        (tmp_path / f"{i}.fsg").write_text(f"FSG_BEGIN g\n{head}\nS 0\nF 3\n{line}\nFSG_END\n")
        with pytest.raises(Exception, match="not an arc|out of range"):
            graphs.read_fsg(spark, str(tmp_path / f"{i}.fsg"))[1].collect()
    for i in (7, 8):
        (tmp_path / f"{i}.two").write_text(f"FSG_BEGIN g\nN 2\nS 0\nF 1\nT 0 1 0.5 w{i}\n")
    g, a = graphs.read_fsg(spark, str(tmp_path / "*.two"), lw=2.0)
    assert {r.fsg for r in g.collect()} == {"7.two#g", "8.two#g"}
    assert {(r.fsg, r.word): pytest.approx(r.logp) for r in a.collect()} == {(f"{i}.two#g", f"w{i}"): 2 * math.log(0.5) for i in (7, 8)}


def test_closure_of_a_cycle(arcs):
    closed = graph.close_epsilon(arcs)
    t = table(closed)
    assert t[1, 3, None] == pytest.approx(math.log(0.125)) and t[2, 1, None] == 0 and t[1, 3, "one"] == pytest.approx(math.log(0.1))
    assert table(graph.close_epsilon(closed)) == t


def test_editing_and_queries(arcs):
    s = table(graph.add_silence(arcs, -3.0))
    assert [s[i, i, "<sil>"] for i in range(4)] == [-3.0] * 4
    assert table(graph.add_alternative(arcs, "go", "go(2)"))[0, 1, "go(2)"] == 0
    assert graph.between(arcs, 1, 2, epsilon=True).count() == 1 and [r.word for r in graph.leaving(arcs, 1).collect()] == ["one", None, None]
    assert [(r.wid, r.word) for r in graph.vocabulary(arcs).orderBy("wid").collect()] == [(0, "go"), (1, "one")]


def test_export(spark, arcs, tmp_path):
    text = [r.line for r in graph.fsg_lines(arcs, 0, 3).orderBy("line_no").collect()]
    assert text[:4] == ["FSG_BEGIN g", "NUM_STATES 4", "START_STATE 0", "FINAL_STATE 3"] and text[-1] == "FSG_END"
    (tmp_path / "again.fsg").write_text("\n".join(text))
    assert {k: round(v, 5) for k, v in table(graphs.read_fsg(spark, str(tmp_path / "again.fsg"))[1]).items()} == {k: round(v, 5) for k, v in table(arcs).items()}
    fsm = [r.line for r in graph.fsm_lines(arcs, 0, 3).orderBy("line_no").collect()]
    assert fsm[0].startswith("0 1 go") and fsm[-1] == "3 0" and any("<eps>" in x for x in fsm)
    assert [r.line for r in graph.symbol_lines(arcs).orderBy("line_no").collect()] == ["<eps> 0", "go 1", "one 2"]


def test_bad_probabilities(spark, tmp_path):
    (tmp_path / "b.fsg").write_text("FSG_BEGIN\nN 2\nS 0\nF 1\nT 0 1 1.5 x\nFSG_END\n")
    with pytest.raises(Exception, match="not an arc"):
        graphs.read_fsg(spark, str(tmp_path / "b.fsg"))[1].collect()


GRAMMAR = """#JSGF V1.0;
/* two
   lines */
grammar shop; // a comment
import <kind.*>;
public <order> = [<polite>] (buy | /0.5/ sell) <thing>+ {tag} <tail>;
<polite> = please | "kind sir";
<thing> = (red | green)* box;
public <tail> = end | and <tail>;
<odd> = <odd> left | x;
"""
KIND = "#JSGF V1.0;\ngrammar kind;\npublic <greet> = hello <who>;\n<who> = you;\n<secret> = no;\n"


def accepts(start, final, arcs, words):
    def close(states):
        todo, seen = list(states), set(states)
        while todo:
            s = todo.pop()
            for a, b, _, w in arcs:
                if a == s and w is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    now = close({start})
    for x in words:
        now = close({b for a, b, _, w in arcs if a in now and w == x})
    return final in now


def test_grammar(spark, tmp_path):
    (tmp_path / "shop.gram").write_text(GRAMMAR)
    (tmp_path / "kind.gram").write_text(KIND)
    g = graphs.load(spark, str(tmp_path / "shop.gram"))
    assert g.public == ["<shop.order>", "<shop.tail>"] and "<kind.greet>" in g.rules
    m = graphs.expand(g)
    thing = r"((red|green) )*box "
    language = re.compile(rf"((please|kind sir) )?(buy|sell) ({thing})+(and )*end$")
    for s in ("buy box end", "please sell red green box box and and end", "kind sir buy box end", "sell box", "buy end", "please box end", "buy red end", "buy box and"):
        words = re.findall(r"kind sir|\S+", s)
        assert accepts(*m, words) == bool(language.match(s)), s
    assert min(p for _, _, p, _ in m[2]) == pytest.approx(math.log(0.5))
    assert "<kind.who>" in g.rules and "<kind.secret>" in g.rules
    greeting = graphs.expand(g, "<kind.greet>")
    assert accepts(*greeting, ["hello", "you"]) and not accepts(*greeting, ["hello"]) and not accepts(*greeting, ["no"])
    for bad in ("<odd>", "<none>"):
        with pytest.raises(ValueError):
            graphs.expand(g, bad)
    table_, arcs = graphs.grammar_arcs(spark, g, "<tail>")
    assert table_.first().fsg == "<shop.tail>" and arcs.where("word = 'and'").count() == 1


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"\xef\xbb\xbffirst\r\n\n# no\n  last \n")
    n = lines.numbered(spark, str(tmp_path / "l.txt"))
    assert [(r.line_no, r.line) for r in n.orderBy("line_no").collect()] == [(1, "first"), (2, ""), (3, "# no"), (4, "  last ")]
    assert [(r.line_no, r.line) for r in lines.clean(n).orderBy("line_no").collect()] == [(1, "first"), (4, "last")]
    assert [r.line.strip() for r in lines.read_lines(spark, str(tmp_path / "l.txt")).orderBy("at").collect()][0] == "first"
