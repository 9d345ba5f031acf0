"""COVERAGE.md against the columns of the queries."""

import os
import re

import __spark_entry__ as entry
from lattiq.plans import queries as plans

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ID = re.compile(r"([A-Z]+)(\d+)")


def listed():
    """Ids of each row of the table, and the queries that it names."""
    with open(os.path.join(HERE, "COVERAGE.md")) as f:
        for line in f:
            cells = [c.strip() for c in line.strip().strip("|").split(" | ")]
            if len(cells) == 3 and cells[0] not in ("Operators", "---"):
                ids = set()
                for part in re.split(r"[,;] *", re.sub(r"\([^)]*\)", "", cells[0])):
                    ends = ID.findall(part)
                    if len(ends) == 2:
                        ids |= {f"{ends[0][0]}{k}" for k in range(int(ends[0][1]), int(ends[1][1]) + 1)}
                    else:
                        ids |= {a + n for a, n in ends}
                yield ids, cells[2]


def queries_of(cell):
    names = re.findall(r"`([a-z_0-9]+\*?)`", cell.replace("*`", "_any`"))
    return {q for n in names for q in plans.QUERIES if q == n or (n.endswith("_any") and q.startswith(n.removesuffix("_any")))}


def test_queries_that_are_named_exist():
    for _, cell in listed():
        for name in re.findall(r"`([a-z_0-9]+)`", cell):
            assert name in plans.QUERIES, name


def test_every_column_is_listed_with_its_query():
    rows = [(ids, queries_of(cell)) for ids, cell in listed()]
    shown = 0
    for name in plans.QUERIES:
        for column in re.findall(r" AS ([a-z]+\d+)(?:s|c)?\b", entry.oracle_sql().get(name, "")):
            if re.match(r"(twv|twm|l|q)\d", column):  # comparisons of integers, norms and quartiles
                continue
            assert any(column.upper() in ids and name in queries for ids, queries in rows), (name, column)
            shown += 1
    assert shown > 450
