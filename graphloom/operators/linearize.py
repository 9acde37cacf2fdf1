"""Method resolution orders of class hierarchies, level by level."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Staging


def c3(own: str, parents: list[list[str]]) -> list[str] | None:
    """The C3 merge of the parents' orders, which begin with the parents; None where they contradict."""
    rows = [list(p) for p in parents] + [[p[0] for p in parents]]
    out = [own]
    while any(rows):
        for r in rows:
            if r and not any(r[0] in x[1:] for x in rows):
                head = r[0]
                break
        else:
            return None
        out.append(head)
        rows = [[x for x in r if x != head] for r in rows]
    return out


def first_wins(own: str, parents: list[list[str]]) -> list[str]:
    """The class, then its parents' orders one after another, each ancestor where it comes first."""
    return list(dict.fromkeys([own, *(x for p in parents for x in p)]))


def single(own: str, parents: list[list[str]]) -> list[str]:
    """The class and the order of its first parent; other parents are no part of it."""
    return [own, *(parents[0] if parents else [])]


def none(own: str, parents: list[list[str]]) -> list[str]:
    return [own]


# The strategies, and the languages that follow each.
STRATEGIES = {"c3": c3, "first-wins": first_wins, "single": single, "none": none}
BY_LANGUAGE = {
    "python": "c3", "cpp": "c3", "kotlin": "c3", "ruby": "c3", "dart": "c3", "typescript": "first-wins", "javascript": "first-wins", "tsx": "first-wins", "rust": "first-wins",
    "java": "single", "csharp": "single", "php": "single", "swift": "single", "c": "none", "go": "none", "cobol": "none",
}


def linearise(links: DataFrame, max_levels: int = 1000, strategy: str = "c3") -> DataFrame:
    """``cls, mro`` for ``links(child, parent, pos)``: each class once all its parents are known.

    A level is one join and one grouped merge over the classes that became ready; a class has as many
    rows as parents.  Classes on or below a cycle never become ready and have no row; contradictory
    orders give a null ``mro`` and end there (with ``c3``; the other strategies have none).  Without positions the parents' order is that of their ids.
    """
    order = STRATEGIES[strategy]
    st = Staging(links.sparkSession, "linearise")
    e = links.where("child is not null and parent is not null").groupBy("child", "parent").agg(F.min("pos").alias("pos"))
    need = st.cut(e.groupBy("child").agg(F.count(F.lit(1)).alias("n")), "need")
    roots = e.select(F.col("parent").alias("cls")).distinct().join(need.select(F.col("child").alias("cls")), "cls", "left_anti")
    done = st.cut(roots.select("cls", F.array("cls").alias("mro")), "level0")
    fresh = done

    @F.pandas_udf("array<string>")
    def merge(own: pd.Series, parents: pd.Series) -> pd.Series:
        return pd.Series([order(o, [list(p["mro"]) for p in ps]) if all(p["mro"] is not None for p in ps) else None for o, ps in zip(own, parents)])

    for level in range(1, max_levels):
        touched = e.join(fresh.select(F.col("cls").alias("parent")), "parent", "left_semi").select("child").distinct()
        known = e.join(touched, "child", "left_semi").join(done.select(F.col("cls").alias("parent"), "mro"), "parent")
        ready = known.groupBy("child").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("pos", "parent", "mro"))).alias("ps")).join(need, "child").where("k = n")
        ready = ready.join(done.select(F.col("cls").alias("child")), "child", "left_anti")
        fresh = st.cut(ready.select(F.col("child").alias("cls"), merge("child", "ps").alias("mro")), f"level{level}")
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    else:
        raise RuntimeError(f"there are more than {max_levels} levels")
    return done
