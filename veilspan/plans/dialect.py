"""Relations by name, for Spark and for the oracle.

Every relation of the release pipeline is a named common table expression. A query is a
SELECT over such names; the needed expressions are put before it in order. The DuckDB text is
the oracle. On Spark the relations that follow from a row alone (LOCAL) come from one walk of
`operators.release` over the subject rows, without any shuffle; the oracle derives the same
relations with joins and windows, so the two share no code. The other relations are the same
SQL on both engines.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspan.operators import release
from veilspan.session import materialize, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Dialect:
    """Functions whose name or syntax differs."""

    name = ""

    def text(self, value: str) -> str:
        raise NotImplementedError

    def d(self, value: float) -> str:
        return f"CAST({value!r} AS DOUBLE)"

    def array(self, values) -> str:
        raise NotImplementedError

    def in_list(self, column: str, values) -> str:
        return f"{column} IN ({', '.join(map(self.text, values))})"


class Spark(Dialect):
    name = "spark"

    def text(self, value):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def array(self, values):
        return f"array({', '.join(map(self.text, values))})"

    def matches(self, column, pattern):
        return f"{column} RLIKE {self.text('(?U)' + pattern)}"

    def findall(self, column, pattern):
        return f"regexp_extract_all({column}, {self.text('(?U)(' + pattern + ')')}, 1)"

    def pieces(self, column, pattern):
        return f"split({column}, {self.text('(?U)' + pattern)}, -1)"

    def sub(self, column, pattern, to):
        return f"regexp_replace({column}, {self.text('(?U)' + pattern)}, {self.text(to)})"

    def at(self, array, index):
        return f"get({array}, {index})"

    def size(self, array):
        return f"size({array})"

    def position(self, text, part):
        return f"instr({text}, {part})"

    def explode(self, source, array, columns, value, index):
        return f"SELECT {columns}, CAST({index} AS INT) AS {index}, {value} FROM {source} LATERAL VIEW posexplode({array}) _x AS {index}, {value}"

    def values(self, rows, columns):
        return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS _v({columns})"

    def collect(self, value, order, where=""):
        if where:
            value, order = f"CASE WHEN {where} THEN {value} END", order
        return f"transform(array_sort(collect_list(CASE WHEN {value} IS NOT NULL THEN struct({order} AS o, {value} AS v) END)), x -> x.v)"

    def join_text(self, array, glue):
        return f"array_join({array}, {self.text(glue)})"

    def distinct(self, array):
        return f"array_distinct({array})"

    def common(self, a, b):
        return f"size(array_intersect({a}, {b}))"

    def map_list(self, array, var, body):
        return f"transform({array}, {var} -> {body})"

    def keep(self, array, var, body):
        return f"filter({array}, {var} -> {body})"

    def grams(self, array, n):
        parts = ", ".join(f"get({array}, i + {j})" for j in range(n))
        return f"CASE WHEN size({array}) >= {n} THEN array_distinct(transform(sequence(0, size({array}) - {n}), i -> concat_ws(' ', {parts}))) ELSE array() END"

    def hex_number(self, text):
        return f"CAST(conv({text}, 16, 10) AS BIGINT)"

    def contains_item(self, array, value):
        return f"array_contains({array}, {value})"

    def sort(self, array):
        return f"array_sort({array})"


class DuckDB(Dialect):
    name = "duckdb"

    def text(self, value):
        return "'" + value.replace("'", "''") + "'"

    def array(self, values):
        return f"[{', '.join(map(self.text, values))}]"

    def _re(self, pattern):
        return self.text(pattern)

    def matches(self, column, pattern):
        return f"regexp_matches({column}, {self._re(pattern)})"

    def findall(self, column, pattern):
        return f"regexp_extract_all({column}, {self._re('(' + pattern + ')')}, 1)"

    def pieces(self, column, pattern):
        return f"regexp_split_to_array({column}, {self._re(pattern)})"

    def sub(self, column, pattern, to):
        return f"regexp_replace({column}, {self._re(pattern)}, {self.text(to.replace('$', chr(92)))}, 'g')"

    def at(self, array, index):
        return f"({array})[{index} + 1]"

    def size(self, array):
        return f"len({array})"

    def position(self, text, part):
        return f"instr({text}, {part})"

    def explode(self, source, array, columns, value, index):
        return f"SELECT {columns}, CAST({index} AS INT) AS {index}, _a[{index} + 1] AS {value} FROM (SELECT *, {array} AS _a, unnest(range(len({array}))) AS {index} FROM {source})"

    def values(self, rows, columns):
        return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) AS _v({columns})"

    def collect(self, value, order, where=""):
        return f"coalesce(list({value} ORDER BY {order}) FILTER (WHERE {value} IS NOT NULL{' AND ' + where if where else ''}), [])"

    def join_text(self, array, glue):
        return f"coalesce(array_to_string({array}, {self.text(glue)}), '')"

    def distinct(self, array):
        return f"list_distinct({array})"

    def common(self, a, b):
        return f"len(list_intersect({a}, {b}))"

    def map_list(self, array, var, body):
        return f"list_transform({array}, lambda {var}: {body})"

    def keep(self, array, var, body):
        return f"list_filter({array}, lambda {var}: {body})"

    def grams(self, array, n):
        return f"CASE WHEN len({array}) >= {n} THEN list_distinct(list_transform(range(1, len({array}) - {n - 2}), lambda i: array_to_string({array}[i:i + {n - 1}], ' '))) ELSE [] END"

    def hex_number(self, text):
        return f"CAST(concat('0x', {text}) AS BIGINT)"

    def contains_item(self, array, value):
        return f"list_contains({array}, {value})"

    def sort(self, array):
        return f"list_sort({array})"


SPARK, DUCKDB = Spark(), DuckDB()

_RELATIONS: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {}


def relation(name: str, *needs: str):
    """Register a relation: a function of the dialect that gives its SELECT."""

    def add(function):
        _RELATIONS[name] = (needs, function)
        return function

    return add


def _ordered(names: tuple[str, ...], found: list[str], local: bool = False) -> list[str]:
    for name in names:
        if name not in found:
            if not (local and name in LOCAL):
                _ordered(_RELATIONS[name][0], found, local)
            found.append(name)
    return found


def render(select: Callable[[Dialect], str], needs: tuple[str, ...], dialect: Dialect) -> str:
    parts = [f"{n} AS MATERIALIZED (\n{_RELATIONS[n][1](dialect)}\n)" for n in _ordered(needs, [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select(dialect)


#: Relations that Spark gets from the row-local operator.
LOCAL = set(release.RELATIONS)

def _views(spark: SparkSession, sf_dir: str, sql: str) -> str:
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for name in TABLES:
        if f"@{name}@" in sql:
            view = f"vs_{mark}_{name}"
            table(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = sql.replace(f"@{name}@", view)
    return sql


def run(spark: SparkSession, sf_dir: str, select: Callable[[Dialect], str], needs: tuple[str, ...] = (), settings: release.Settings | None = None, within: str | None = None, instead: dict[str, str] | None = None) -> DataFrame:
    """Spark SQL over the Parquet tables of `sf_dir`, written @name@ in the text.

    LOCAL relations are derived from the subject rows, one walk each; one that is read more than
    once is written to shared storage first, so a lost executor costs no more than a re-read.
    `within` is a relation of few rows to which all LOCAL relations after it are joined by row_id:
    it is written once, and those are derived from its subject rows alone. Those before it are
    derived without labels, which are joined to what they yield: the texts then need no shuffle.
    `instead` has other texts of relations.
    """
    order = _ordered(needs, [], True)
    bodies = {n: _RELATIONS[n][1](SPARK) for n in order if n not in LOCAL} | (instead or {})
    final = select(SPARK)
    uses = {n: sum(len(re.findall(rf"\b(?:FROM|JOIN)\s+{n}\b", text)) for text in [*bodies.values(), final]) for n in order}
    subject = None

    def put(n: str, df: DataFrame) -> None:
        view = f"vs_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        bodies[n] = f"SELECT * FROM {view}"

    def sql(names: list[str], text: str) -> DataFrame:
        parts = [f"{n} AS (\n{bodies[n]}\n)" for n in names]
        return spark.sql(_views(spark, sf_dir, ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text))

    for i, n in enumerate(order):
        if n in LOCAL:
            if subject is None:
                bare = {"rows": _RELATIONS["unlabelled_rows"][1](SPARK)} if within else None
                subject = run(spark, sf_dir, lambda q: "SELECT * FROM subject", ("subject",), instead=bare)
            df = release.derive(subject, n, settings)
            put(n, materialize(df, n.replace("_", "-")) if uses[n] > 1 else df)
            if within in order[i:] and "binary_label" in df.columns:
                bodies[n] = f"SELECT x.* EXCEPT (binary_label), CAST(l.toxic AS INT) AS binary_label FROM ({bodies[n]}) x LEFT JOIN @labels@ l ON x.row_id = l.doc_id"
        elif n == within:
            df = materialize(sql(order[: i + 1], f"SELECT * FROM {n}"), n.replace("_", "-"))
            put(n, df)
            # As a condition it is pushed down to the scan of the rows.
            few = f"SELECT * FROM subject WHERE row_id IN (SELECT row_id FROM ({bodies[n]}))"
            subject = materialize(run(spark, sf_dir, lambda q: few, ("subject",)), "subject")
    return sql(order, final)


def plan(name: str, *needs: str, oracle: bool = True, within: str | None = None):
    """Register a query that is a SELECT over relations, with its oracle."""
    from veilspan import registry

    def add(select):
        def duck() -> str:
            text = render(select, needs, DUCKDB)
            for t in TABLES:
                text = text.replace(f"@{t}@", t)
            return text

        # Rendered when asked for: a relation may be registered after the queries that use it.
        registry.query(name, duck if oracle else None)(lambda spark, sf_dir: run(spark, sf_dir, select, needs, within=within))
        return select

    return add
