"""A session for SQL text in this engine's dialect: queries on Spark SQL, and tables that statements change.

A table's contents are Parquet in the shared folder; a change writes a new version with DataFrame operators and checks
the constraints before the new version counts. Every row carries a hidden number, by which UPDATE and DELETE find rows.
There is one writer. What fails leaves the table as it was; a transaction's savepoints are references to old versions.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.operators import dml
from relquill.operators import relational as R
from relquill.plans import dialect as Q
from relquill.plans.dialect import Tok
from relquill.sources import text
from relquill.sources.storage import stage

RID = "__rq_row"


@dataclass
class ColumnDef:
    name: str
    kind: str
    default: str | None = None
    not_null: bool = False
    generated: str | None = None
    identity: dml.Sequence | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    parent: str
    target: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    name: str | None = None


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)
    data: DataFrame | None = None
    period: tuple[str, str] | None = None  # columns of SYSTEM_TIME
    versioned: bool = False
    named: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # constraints of keys: PRIMARY or UNIQUE, and the columns

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


@dataclass
class Trigger:
    """Statements that run around a change. ``new`` and ``old`` name the transition tables; row triggers are run on all rows at once."""

    table: str
    before: bool
    event: str
    new: str | None
    old: str | None
    each_row: bool
    body: list[Tok]


@dataclass
class Procedure:
    """``parameters``: (IN, OUT or INOUT, name, Spark type)."""

    parameters: list[tuple[str, str, str]]
    body: list[Tok]


class Engine:
    """SQL statements over a Spark session. Unquoted names are compared without regard to case."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, TableDef] = {}
        self.sequences: dict[str, dml.Sequence] = {}
        self.triggers: dict[str, Trigger] = {}
        self.last_identity: int | None = None
        self.domains: dict[str, list[Tok]] = {}
        self.comments: dict[tuple[str, str], str] = {}
        self.procedures: dict[tuple[str, int], Procedure] = {}
        self._saved: list[tuple[str | None, dict[str, TableDef]]] = []

    # --- entry

    def sql(self, statement: str, args=None) -> DataFrame | int:
        """A query's rows, or the number of rows that a change touched (0 for definitions)."""
        items = Q.tokens(statement.strip().rstrip(";"))
        if not items:
            return 0
        words = [t.up for t in items[:6]]
        for names, run in self._statements().items():
            if tuple(words[: len(names)]) == names:
                return self._whole(run, items) if names[0] in ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "TRUNCATE") else run(items)
        if words[0] in ("SELECT", "WITH", "VALUES", "TABLE") or items[0].kind == "g":
            return self.query(items, args)
        raise ValueError(f"42581 unexpected token: {items[0].text}")

    def script(self, statements: str) -> list[DataFrame | int]:
        """Statements one after another, separated by semicolons (IMPORT SCRIPT)."""
        return [self.sql(Q.render(part)) for part in self._parts(Q.tokens(statements))]

    @staticmethod
    def _parts(items: list[Tok]) -> list[list[Tok]]:
        """Statements between semicolons; those inside BEGIN .. END and CASE .. END do not count."""
        out, part, depth = [], [], 0
        for t in [*items, Tok("o", ";")]:
            depth += (t.up in ("BEGIN", "CASE")) - (t.up == "END" and depth > 0)
            if t.text == ";" and t.kind == "o" and depth == 0:
                if part:
                    out.append(part)
                part = []
            else:
                part.append(t)
        return out

    # --- transactions: versions are immutable, so a savepoint is a set of references

    def _snapshot(self) -> dict[str, TableDef]:
        return {n: replace(t, columns=[replace(c) for c in t.columns], unique=list(t.unique), checks=dict(t.checks), foreign=list(t.foreign), named=dict(t.named)) for n, t in self.tables.items()}

    def _whole(self, run, items: list[Tok]) -> int:
        """A change as a whole: where it fails, every table is as it was."""
        saved = self._snapshot()
        try:
            return run(items)
        except Exception:
            self.tables = saved
            for t in saved.values():
                self._show(t)
            raise

    def _begin(self, items: list[Tok]) -> int:
        self._saved = [(None, self._snapshot())]
        return 0

    def _savepoint(self, items: list[Tok]) -> int:
        self._saved.append((items[1].text.lower(), self._snapshot()))
        return 0

    def _commit(self, items: list[Tok]) -> int:
        self._saved = []
        return 0

    def _rollback(self, items: list[Tok]) -> int:
        if not self._saved:
            return 0
        at = 0
        if (i := Q._find(items, "SAVEPOINT")) > 0:
            found = [n for n, (name, _) in enumerate(self._saved) if name == items[i + 1].text.lower()]
            if not found:
                raise ValueError(f"3B001 invalid savepoint: {items[i + 1].text}")
            at = found[-1]
        for name in set(self.tables) - set(self._saved[at][1]):
            self.spark.catalog.dropTempView(name)
        self.tables = self._saved[at][1]
        self._saved = self._saved[: at + 1] if at else []
        if at:
            self._saved[at] = (self._saved[at][0], self._snapshot())
        for t in self.tables.values():
            self._show(t)
        return 0

    # --- routines and triggers

    def _block(self, items: list[Tok]) -> DataFrame | int:
        """BEGIN [ATOMIC] .. END: a block of statements on tables runs here, one with variables or loops as a Spark SQL script."""
        body = items[2 if items[1].up == "ATOMIC" else 1 : -1]
        parts = self._parts(body)
        if any(p[0].up in ("DECLARE", "SET", "IF", "WHILE", "REPEAT", "LOOP", "FOR", "CASE") or len(p) > 1 and p[1].text == ":" for p in parts):
            return self.spark.sql("BEGIN " + Q.render(body) + " END")
        out: DataFrame | int = 0
        for p in parts:
            out = self.sql(Q.render(p))
        return out

    def _trigger(self, items: list[Tok]) -> int:
        """CREATE TRIGGER n {BEFORE | AFTER} event ON t [REFERENCING ..] [FOR EACH {ROW | STATEMENT}] statement"""
        name, before, event = items[2].text.lower(), items[3].up == "BEFORE", items[4].up
        on = Q._find(items, "ON")
        table, at = self._name(items, on + 1)
        names: dict[str, str] = {}
        if at < len(items) and items[at].up == "REFERENCING":
            at += 1
            while items[at].up in ("NEW", "OLD"):
                kind = items[at].up
                at += 1 + (items[at + 1].up in ("ROW", "TABLE"))
                at += items[at].up == "AS"
                names[kind] = items[at].text.lower()
                at += 1
        each_row = False
        if [t.up for t in items[at : at + 2]] == ["FOR", "EACH"]:
            each_row, at = items[at + 2].up == "ROW", at + 3
        self.triggers[name] = Trigger(table, before, event, names.get("NEW"), names.get("OLD"), each_row, items[at:])
        return 0

    def _fire(self, t: TableDef, before: bool, event: str, new: DataFrame | None, old: DataFrame | None) -> DataFrame | None:
        """Runs the triggers of a change; BEFORE row triggers may SET columns of the new rows, which are returned."""
        for g in [g for g in self.triggers.values() if (g.table, g.before, g.event) == (t.name, before, event)]:
            for name, rows in ((g.new, new), (g.old, old)):
                if name and rows is not None:
                    rows.drop(RID).createOrReplaceTempView(name)
            body = g.body[2 if g.body[1].up == "ATOMIC" else 1 : -1] if g.body[0].up == "BEGIN" else g.body
            for part in self._parts(body):
                if part[0].up == "SET" and before and new is not None:
                    for cell in Q.split(part[1:]):
                        eq = next(i for i, x in enumerate(cell) if x.text == "=")
                        c = next(c for c in t.columns if c.name == cell[eq - 1].text.lower())
                        new = new.alias(g.new).withColumn(c.name, F.expr(self.expression(cell[eq + 1 :])).cast(c.kind))
                elif part[0].up == "INSERT" and g.each_row and (v := Q._find(part, "VALUES")) > 0:
                    rows = " CROSS JOIN ".join(n for n, d in ((g.new, new), (g.old, old)) if n and d is not None)
                    if g.new and g.old and new is not None and old is not None:  # a row's versions meet by its number
                        pairs = new.select(*[F.col(c).alias(f"rq_new_{c}") for c in t.names], RID).join(old.select(*[F.col(c).alias(f"rq_old_{c}") for c in t.names], RID), RID)
                        pairs = pairs.select(F.struct(*[F.col(f"rq_new_{c}").alias(c) for c in t.names]).alias(g.new), F.struct(*[F.col(f"rq_old_{c}").alias(c) for c in t.names]).alias(g.old))
                        pairs.createOrReplaceTempView("rq_pairs")
                        rows = "rq_pairs"
                    self.sql(f"{Q.render(part[:v])} SELECT {Q.render(part[v + 1].items)} FROM {rows}")
                elif part[0].up == "SIGNAL":
                    if (new if new is not None else old) is not None and not (new if new is not None else old).isEmpty():
                        raise ValueError(f"{Q.render(part[2:])} raised by a trigger of {t.name}")
                else:
                    self.sql(Q.render(part))
        return new

    def _statements(self):
        nothing = lambda _: 0
        return {
            ("INSERT", "INTO"): self._insert, ("UPDATE",): self._update, ("DELETE", "FROM"): self._delete, ("TRUNCATE", "TABLE"): self._truncate, ("MERGE", "INTO"): self._merge,
            ("REPLACE", "INTO"): self._insert, ("INSERT", "IGNORE", "INTO"): self._insert, ("CREATE", "VIEW"): self._view, ("CREATE", "OR", "REPLACE", "VIEW"): self._view, ("CREATE", "SEQUENCE"): self._sequence, ("CREATE", "FUNCTION"): self._function, ("CREATE", "PROCEDURE"): self._procedure, ("DROP", "PROCEDURE"): self._drop_procedure,
            ("CREATE", "INDEX"): nothing, ("CREATE", "UNIQUE", "INDEX"): nothing, ("COMMENT", "ON"): self._comment, ("SET", "TABLE"): self._source, ("SET",): self._setting, ("START", "TRANSACTION"): self._begin, ("SAVEPOINT",): self._savepoint,
            ("RELEASE", "SAVEPOINT"): nothing, ("COMMIT",): self._commit, ("ROLLBACK",): self._rollback, ("CREATE", "TRIGGER"): self._trigger, ("BEGIN",): self._block, ("CREATE",): self._create, ("DROP",): self._drop, ("ALTER", "TABLE"): self._alter, ("EXPLAIN", "PLAN", "FOR"): self._explain, ("CALL",): self._call,
            ("PERFORM", "EXPORT", "DATA"): self._export, ("PERFORM", "IMPORT", "DATA"): self._import, ("PERFORM", "IMPORT", "SCRIPT"): self._import_script, ("SCRIPT",): lambda _: self.dump(),
        }

    # --- queries

    def types(self, scope: str, expressions: list[str]) -> list[str]:
        """Spark types of expressions over a FROM clause, by analysis alone; "?" where a correlated name cannot be resolved."""
        try:
            schema = self.spark.sql(scope.replace("%s", ", ".join(f"({e}) AS rq_{i}" for i, e in enumerate(expressions)), 1)).schema
            return [f.dataType.simpleString() for f in schema]
        except Exception as error:  # noqa: BLE001  analysis alone: a name of an outer query
            if "UNRESOLVED" in str(error) or "PARSE" in str(error) or "ParseException" in type(error).__name__ or "UNBOUND" in str(error):
                return ["?"] * len(expressions)
            raise

    def query(self, items: list[Tok], args=None) -> DataFrame:
        at = Q._find(items, "CORRESPONDING")
        if at > 0:
            return self._corresponding(items, at)
        if (recursive := self._recursive(items)) is not None:
            return recursive
        items = self._system_time(self._with_sequences(items))
        text_ = Q.render(Q.rewrite(items, self.types))
        return self.spark.sql(text_, args=args) if args is not None else self.spark.sql(text_)

    def _recursive(self, items: list[Tok]) -> DataFrame | None:
        """WITH RECURSIVE c (..) AS (seed UNION step): distinct rows, step by step; UNION ALL is left to Spark."""
        if [t.up for t in items[:2]] != ["WITH", "RECURSIVE"] or items[3].kind != "g" or items[4].up != "AS":
            return None
        body, main = items[5].items, items[6:]
        at = next((i for i, t in enumerate(body) if t.up == "UNION"), -1)
        if at < 0 or body[at + 1].up == "ALL" or not main or main[0].up == ",":
            return None
        name = items[2].text.lower()
        columns = [Q.render(c).lower() for c in Q.split(items[3].items)]

        def step(rows: DataFrame) -> DataFrame:
            rows.createOrReplaceTempView(name)
            return self.query(body[at + 1 + (body[at + 1].up == "DISTINCT") :]).toDF(*columns)

        R.recursive_union(self.query(body[:at]).toDF(*columns), step).createOrReplaceTempView(name)
        return self.query(main)

    def _corresponding(self, items: list[Tok], at: int) -> DataFrame:
        op_at = max(i for i in range(at) if items[i].up in Q._SETS)
        every = any(t.up == "ALL" for t in items[op_at:at])
        by, right = None, items[at + 1 :]
        if right and right[0].up == "BY":
            by, right = [Q.render(c) for c in Q.split(right[1].items)], right[2:]
        op = items[op_at].up.replace("MINUS", "EXCEPT") + (" ALL" if every else "")
        return R.corresponding(self.query(items[:op_at]), self.query(right), op, by)

    def _with_sequences(self, items: list[Tok]) -> list[Tok]:
        """NEXT VALUE FOR s, CURRENT VALUE FOR s and IDENTITY() in a query without a table, SESSION_ID() in any."""
        out, i = [], 0
        while i < len(items):
            if [t.up for t in items[i : i + 3]] == ["NEXT", "VALUE", "FOR"]:
                out.append(Tok("n", str(self.sequences[items[i + 3].text.lower()].next())))
                i += 4
            elif [t.up for t in items[i : i + 3]] == ["CURRENT", "VALUE", "FOR"]:
                out.append(Tok("n", str(self.sequences[items[i + 3].text.lower()].last)))
                i += 4
            elif items[i].up == "IDENTITY" and i + 1 < len(items) and items[i + 1].kind == "g" and not items[i + 1].items:
                out.append(Tok("n", "NULL" if self.last_identity is None else str(self.last_identity)))
                i += 2
            elif items[i].up == "SESSION_ID" and i + 1 < len(items) and items[i + 1].kind == "g" and not items[i + 1].items:
                out.append(Tok("s", f"'{self.spark.sparkContext.applicationId}'"))
                i += 2
            else:
                t = items[i]
                out.append(Tok("g", t.text, self._with_sequences(t.items)) if t.kind == "g" else t)
                i += 1
        return out

    def _system_time(self, items: list[Tok]) -> list[Tok]:
        """t FOR SYSTEM_TIME {AS OF x | FROM x TO y | BETWEEN x AND y}: a selection of the table's versions."""
        items = [Tok("g", t.text, self._system_time(t.items)) if t.kind == "g" else t for t in items]
        while (i := Q._find(items, "FOR", "SYSTEM_TIME")) > 0:
            t = self._table(items[i - 1].text.lower())
            a, b = t.period
            kind = items[i + 2].up
            first = i + (4 if kind == "AS" else 3)

            def value(at: int) -> int:  # a literal (TIMESTAMP '..'), a call or a name
                end = at + 1
                while end < len(items) and items[end].kind in "sg":
                    end += 1
                return end

            end = value(first)
            x = Q.render(items[first:end])
            if kind == "AS":
                test = f"{a} <= {x} AND {b} > {x}"
            else:
                last = value(end + 1)
                y = Q.render(items[end + 1 : last])
                test = f"{b} > {x} AND {a} {'<' if kind == 'FROM' else '<='} {y}"
                end = last
            named = end < len(items) and (items[end].up == "AS" or items[end].kind in "wq" and items[end].up not in Q._FROM_END | {"JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "ON", "USING"})
            new = Q.tokens(f"(SELECT * FROM {t.name}__versions WHERE {test})" + ("" if named else f" AS {t.name}"))
            items = items[: i - 1] + new + items[end:]
        return items

    def _explain(self, items: list[Tok]) -> DataFrame:
        plan = self.query(items[3:])._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")

    def _call(self, items: list[Tok]) -> DataFrame | int:
        if len(items) == 3 and items[2].kind == "g":
            given = Q.split(items[2].items) if items[2].items else []
            if (called := self.procedures.get((items[1].text.lower(), len(given)))) is not None:
                return self._whole(lambda _: self._perform(called, given), items)
        return self.query([Tok("w", "SELECT"), *items[1:], *Q.tokens("AS result")])

    def _procedure(self, items: list[Tok]) -> int:
        """CREATE PROCEDURE p([IN | OUT | INOUT] a type, ..) [characteristics] statement; names are told apart by the number of parameters."""
        parameters = []
        for part in Q.split(items[3].items) if items[3].items else []:
            mode = part[0].up if part[0].up in ("IN", "OUT", "INOUT") else "IN"
            part = part[1:] if part[0].up == mode else part
            parameters.append((mode, part[0].text.lower(), Q.spark_type(part[1:])[0]))
        first = next((i for i in range(4, len(items)) if items[i].up in ("BEGIN", "SET", "INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "REPLACE", "SELECT")), None)
        if first is None:
            raise ValueError("42590 unexpected end of statement: a procedure needs a statement")
        self.procedures[items[2].text.lower(), len(parameters)] = Procedure(parameters, items[first:])
        return 0

    def _drop_procedure(self, items: list[Tok]) -> int:
        found = [k for k in self.procedures if k[0] == items[2].text.lower()]
        if not found and Q._find(items, "IF", "EXISTS") < 0:
            raise ValueError(f"42501 user lacks privilege or object not found: {items[2].text}")
        for k in found:
            del self.procedures[k]
        return 0

    def _perform(self, p: Procedure, given: list[list[Tok]]) -> DataFrame | int:
        """A call: statements in turn, with the parameters' values in their places. The OUT values come back as one row.

        A body with variables or control statements runs as a Spark SQL script instead; it cannot change the session's tables.
        """
        outs = [(n, k) for mode, n, k in p.parameters if mode != "IN"]
        values: dict[str, list[Tok]] = {n: [Tok("n", f"CAST({Q.render(g) if mode != 'OUT' else 'NULL'} AS {k})")] for (mode, n, k), g in zip(p.parameters, given, strict=True)}

        def filled(items: list[Tok], names) -> list[Tok]:
            out: list[Tok] = []
            for i, t in enumerate(items):
                if t.kind == "g":
                    out.append(Tok("g", t.text, filled(t.items, names)))
                elif t.kind == "w" and t.text.lower() in names and not (i > 0 and items[i - 1].text == "."):
                    out += values[t.text.lower()]
                else:
                    out.append(t)
            return out

        body = p.body[2 if len(p.body) > 1 and p.body[1].up == "ATOMIC" else 1 : -1] if p.body[0].up == "BEGIN" else p.body
        if any(t.up in ("DECLARE", "IF", "WHILE", "REPEAT", "LOOP", "FOR") and not (t.up == "IF" and i + 1 < len(body) and body[i + 1].up in ("EXISTS", "NOT")) for i, t in enumerate(body)):
            declared = " ".join(f"DECLARE {n} {k} DEFAULT {Q.render(values[n])};" for n, k in outs)
            rest = Q.render(filled(body, {n for mode, n, _ in p.parameters if mode == "IN"})).rstrip().rstrip(";")
            return self.spark.sql(f"BEGIN {declared} {rest}; {f'SELECT {", ".join(n for n, _ in outs)};' if outs else ''} END")
        kinds, result = dict(outs), 0
        for part in self._parts(body):
            targets: list[str] = []
            if part[0].up == "SET":
                eq = next(i for i, t in enumerate(part) if t.text == "=")
                targets, part = [part[1].text.lower()], [Tok("w", "SELECT"), *part[eq + 1 :]]
            elif part[0].up == "SELECT" and (into := Q._find(part, "INTO")) > 0:
                end = Q._find(part, "FROM", start=into)
                targets = [c[0].text.lower() for c in Q.split(part[into + 1 : end])]
                part = part[:into] + part[end:]
            result = self.sql(Q.render(filled(part, values)))
            if targets:
                if any(n not in kinds for n in targets):
                    raise ValueError(f"0A000 feature not supported: a value for {', '.join(targets)}")
                row = result.head()  # a single-row SELECT
                for n, v in zip(targets, row if row is not None else [None] * len(targets), strict=True):
                    plain = Tok("w", "NULL") if v is None else Tok("s", "'" + str(v).replace("'", "''") + "'")
                    values[n] = [Tok("w", "CAST"), Tok("g", "()", [plain, *Q.tokens(f"AS {kinds[n]}")])]
        return self.spark.sql(f"SELECT {', '.join(f'{Q.render(values[n])} AS {n}' for n, _ in outs)}") if outs else result

    def expression(self, text_: str | list[Tok]) -> str:
        return Q.render(Q.rewrite(Q.tokens(text_) if isinstance(text_, str) else text_, None))

    # --- definitions

    def _store(self, t: TableDef, rows: DataFrame) -> None:
        """The new contents of a table, checked and written; rows need the hidden number no more than the old ones did."""
        data = stage(rows.select(*[F.col(c.name).cast(c.kind).alias(c.name) for c in t.columns]).withColumn(RID, F.monotonically_increasing_id()), t.name)
        self._check(t, dml.current_rows(data, t.period[1]) if t.versioned else data)
        t.data = data
        self._show(t)

    def _show(self, t: TableDef) -> None:
        """The table's views: its current rows, and beside them every version."""
        rows = t.data.drop(RID)
        if t.versioned:
            rows.createOrReplaceTempView(f"{t.name}__versions")
            rows = dml.current_rows(rows, t.period[1])
        rows.createOrReplaceTempView(t.name)

    def _check(self, t: TableDef, data: DataFrame) -> None:
        foreign = [(f.columns, (data if f.parent == t.name else self.tables[f.parent].data), f.target) for f in t.foreign]
        asked = {
            "not_null": [c.name for c in t.columns if c.not_null] + [k for k in t.key if not next(c for c in t.columns if c.name == k).not_null],
            "check": {n: F.expr(e) for n, e in t.checks.items()}, "unique": ([t.key] if t.key else []) + t.unique, "foreign": foreign,
        }
        if any(asked.values()):
            broken = [r["constraint"] for r in dml.violations(data, **asked).where("n > 0").collect()]
            if broken:
                raise ValueError(f"23000 integrity constraint violation: {', '.join(sorted(broken))} of {t.name}")

    def _name(self, items: list[Tok], at: int) -> tuple[str, int]:
        """A table name (its schema is left out) and where it ends."""
        while at + 1 < len(items) and items[at + 1].up == ".":
            at += 2
        t = items[at]
        return (t.text.strip('"') if t.kind == "q" else t.text.lower()), at + 1

    def _create(self, items: list[Tok]) -> int:
        at = Q._find(items, "TABLE")
        if at < 0:
            return self._other(items)
        at += 1
        if [t.up for t in items[at : at + 3]] == ["IF", "NOT", "EXISTS"]:
            at += 3
            if self._name(items, at)[0] in self.tables:
                return 0
        name, at = self._name(items, at)
        if name in self.tables:
            raise ValueError(f"42504 object name already exists: {name}")
        if at < len(items) and items[at].kind == "g" and not Q._is_query(items[at]):
            body, at = items[at].items, at + 1
            if body and body[0].up == "LIKE":
                other = self.tables[self._name(body, 1)[0]]
                t = TableDef(name, [ColumnDef(c.name, c.kind, not_null=c.not_null) for c in other.columns])
            elif at < len(items) and items[at].up == "AS":
                t = TableDef(name, [])
                names = [Q.render(c) for c in Q.split(body)]
                return self._create_as(t, items[at + 1 :], names)
            else:
                t = TableDef(name, [])
                for part in Q.split(body):
                    self._element(t, part)
                t.versioned = t.period is not None and Q._find(items, "SYSTEM", "VERSIONING") > 0
        elif at < len(items) and items[at].up == "AS":
            return self._create_as(TableDef(name, []), items[at + 1 :], None)
        else:
            raise ValueError("42590 unexpected end of statement")
        self.tables[name] = t
        self._store(t, self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.kind}" for c in t.columns)))
        return 0

    def _other(self, items: list[Tok]) -> int:
        """CREATE DOMAIN, TYPE, SYNONYM and SCHEMA; what has no meaning here is refused."""
        word = items[1].up
        if word in ("DOMAIN", "TYPE"):
            name, at = self._name(items, 2)
            self.domains[name] = items[at + (items[at].up == "AS") :]
        elif word == "SYNONYM":
            name, at = self._name(items, 2)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM `{self._name(items, at + 1)[0]}`")
        elif word != "SCHEMA":  # names of schemas are read over
            raise ValueError(f"0A000 feature not supported: CREATE {word}")
        return 0

    def _setting(self, items: list[Tok]) -> int:
        """SET SCHEMA is read over, SET TIME ZONE sets the session's; other settings are refused."""
        words = [t.up for t in items[1:3]]
        if words == ["TIME", "ZONE"]:
            zone = items[-1]
            self.spark.conf.set("spark.sql.session.timeZone", "UTC" if zone.up == "LOCAL" else zone.text.strip("'"))
        elif words[:1] != ["SCHEMA"]:
            raise ValueError(f"0A000 feature not supported: SET {' '.join(words)}")
        return 0

    def _comment(self, items: list[Tok]) -> int:
        """COMMENT ON {TABLE | COLUMN | ..} name IS 'text'"""
        at = Q._find(items, "IS")
        self.comments[items[2].up, "".join(t.text for t in items[3:at]).lower()] = items[at + 1].text[1:-1].replace("''", "'")
        return 0

    def _create_as(self, t: TableDef, items: list[Tok], names: list[str] | None) -> int:
        with_data = Q._find(items, "NO", "DATA") < 0
        end = Q._find(items, "WITH", "DATA")
        end = Q._find(items, "WITH", "NO", "DATA") if end < 0 else end
        rows = self.query(items[: end if end >= 0 else len(items)])
        rows = rows.toDF(*(names or [c.lower() for c in rows.columns]))
        t.columns = [ColumnDef(n, k) for n, k in rows.dtypes]
        self.tables[t.name] = t
        self._store(t, rows if with_data else rows.limit(0))
        return 0

    def _element(self, t: TableDef, part: list[Tok]) -> None:
        """A column or a constraint of CREATE TABLE."""
        name = None
        if part[0].up == "CONSTRAINT":
            name, part = part[1].text.lower(), part[2:]
        word = part[0].up
        if word in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN") and (word != "UNIQUE" or part[1].kind == "g"):
            self._constraint(t, part, name)
            return
        if word == "PERIOD":  # other periods are named pairs of columns: their predicates take the columns
            if part[2].up == "SYSTEM_TIME":
                a, b = (Q.render(x).lower() for x in Q.split(part[3].items))
                t.period = (a, b)
            return
        column = part[0].text.strip('"') if part[0].kind == "q" else part[0].text.lower()
        rest = part[1:]
        if (domain := self.domains.get(rest[0].text.lower())) is not None:
            rest = [Tok(t.kind, column) if t.up == "VALUE" else t if t.kind != "g" else self._valued(t, column) for t in domain] + rest[1:]
        if rest[0].up in ("IDENTITY",):
            c = ColumnDef(column, "int", identity=dml.Sequence(0), not_null=True)
            i = 1
        else:
            kind, i = Q.spark_type(rest)
            c = ColumnDef(column, kind)
        t.columns.append(c)
        while i < len(rest):
            up = rest[i].up
            if up == "NOT":
                c.not_null, i = True, i + 2
            elif up == "DEFAULT":
                end = i + 1
                while end < len(rest) and rest[end].up not in ("NOT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", "CONSTRAINT"):
                    end += 1
                c.default, i = self.expression(rest[i + 1 : end]), end
            elif up == "PRIMARY":
                t.key, i = [column], i + 2
            elif up == "UNIQUE":
                t.unique.append([column])
                i += 1
            elif up == "CHECK":
                t.checks[f"{column} {len(t.checks)}"] = self.expression(rest[i + 1].items)
                i += 2
            elif up == "REFERENCES":
                parent, i = self._name(rest, i + 1)
                target = [Q.render(x).lower() for x in Q.split(rest[i].items)] if i < len(rest) and rest[i].kind == "g" else self.tables[parent].key
                t.foreign.append(ForeignKey([column], parent, target, self._action(rest[i:]), self._action(rest[i:], "UPDATE"), name))
                break
            elif up == "GENERATED":
                where = Q._find(rest, "AS", start=i)
                if rest[where + 1].up == "ROW":  # GENERATED ALWAYS AS ROW START / END
                    i = where + 3
                elif rest[where + 1].kind == "g":
                    c.generated, i = self.expression(rest[where + 1].items), where + 2
                else:
                    c.identity, c.not_null, i = dml.Sequence(*self._sequence_options(rest[where + 2].items if where + 2 < len(rest) and rest[where + 2].kind == "g" else [], 0)), True, where + 3
            elif up == "IDENTITY":
                c.identity, c.not_null, i = dml.Sequence(0), True, i + 1
            else:
                i += 1

    def _valued(self, group: Tok, column: str) -> Tok:
        """A group of a domain's definition with VALUE replaced by the column."""
        return replace(group, items=[Tok("w", column) if t.up == "VALUE" and t.kind == "w" else t for t in group.items])

    def _action(self, items: list[Tok], event: str = "DELETE") -> str:
        at = Q._find(items, "ON", event)
        if at < 0:
            return "NO ACTION"
        words = items[at + 2].up
        return words if words in ("CASCADE", "RESTRICT") else f"{words} {items[at + 3].up}"

    def _constraint(self, t: TableDef, part: list[Tok], name: str | None) -> None:
        word = part[0].up
        columns = lambda g: [Q.render(x).lower() for x in Q.split(g.items)]
        if word == "PRIMARY":
            t.named[name or "primary key"] = ("PRIMARY", [])
            t.key = columns(part[2])
        elif word == "UNIQUE":
            t.unique.append(columns(part[1]))
            if name:
                t.named[name] = ("UNIQUE", t.unique[-1])
        elif word == "CHECK":
            t.checks[name or f"check {len(t.checks)}"] = self.expression(part[1].items)
        else:
            own = columns(part[2])
            parent, at = self._name(part, 4)
            target = columns(part[at]) if at < len(part) and part[at].kind == "g" else self.tables[parent].key
            t.foreign.append(ForeignKey(own, parent, target, self._action(part), self._action(part, "UPDATE"), name))

    def _drop(self, items: list[Tok]) -> int:
        kind = items[1].up
        at = 4 if [t.up for t in items[2:4]] == ["IF", "EXISTS"] else 2
        quiet = at == 4 or Q._find(items, "IF", "EXISTS") > 0
        name = self._name(items, at)[0]
        if kind == "TABLE":
            if name not in self.tables:
                if quiet:
                    return 0
                raise ValueError(f"42501 user lacks privilege or object not found: {name}")
            users = [t.name for t in self.tables.values() if t.name != name and any(f.parent == name for f in t.foreign)]
            if users and Q._find(items, "CASCADE") < 0:
                raise ValueError(f"42533 dependent objects exist: {', '.join(users)}")
            for u in users:
                self.tables[u].foreign = [f for f in self.tables[u].foreign if f.parent != name]
            del self.tables[name]
            self.spark.catalog.dropTempView(name)
        elif kind == "VIEW":
            self.spark.catalog.dropTempView(name)
        elif kind == "SEQUENCE":
            self.sequences.pop(name, None)
        elif kind == "TRIGGER":
            self.triggers.pop(name, None)
        elif kind == "FUNCTION":
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return 0

    def _forget(self, t: TableDef, name: str) -> None:
        """DROP CONSTRAINT: a check, key, unique or foreign key by its name."""
        if name in t.checks:
            del t.checks[name]
        elif name in t.named:
            kind, columns = t.named.pop(name)
            if kind == "PRIMARY":
                t.key = []
            else:
                t.unique.remove(columns)
        elif any(f.name == name for f in t.foreign):
            t.foreign = [f for f in t.foreign if f.name != name]
        else:
            raise ValueError(f"42501 user lacks privilege or object not found: {name}")

    def _alter(self, items: list[Tok]) -> int:
        name, at = self._name(items, 2)
        t = self.tables[name]
        words = [x.up for x in items[at : at + 3]]
        rest = items[at:]
        if words[0] == "ADD" and words[1] in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
            self._element(t, rest[1:])
            self._check(t, t.data)
        elif words[0] == "ADD":
            before = len(t.columns)
            self._element(t, rest[2 if words[1] == "COLUMN" else 1 :])
            c = t.columns[before]
            value = F.expr(c.generated or c.default or "NULL").cast(c.kind)
            self._store(t, t.data.withColumn(c.name, value))
        elif words[0] == "DROP":
            if words[1] == "CONSTRAINT":
                self._forget(t, rest[2].text.lower())
                return 0
            if words[1:3] == ["PRIMARY", "KEY"]:
                t.key = []
                return 0
            gone = rest[2 if words[1] == "COLUMN" else 1].text.lower()
            t.columns = [c for c in t.columns if c.name != gone]
            self._store(t, t.data.drop(gone))
        elif words[:2] == ["RENAME", "TO"]:
            new = rest[2].text.lower()
            self.tables[new] = self.tables.pop(name)
            t.name = new
            self.spark.catalog.dropTempView(name)
            t.data.drop(RID).createOrReplaceTempView(new)
        elif words[0] == "ALTER":
            i = 2 if words[1] == "COLUMN" else 1
            column = next(c for c in t.columns if c.name == rest[i].text.lower())
            change = [x.up for x in rest[i + 1 : i + 4]]
            if change[:2] == ["RENAME", "TO"]:
                new = rest[i + 3].text.lower()
                data = t.data.withColumnRenamed(column.name, new)
                column.name = new
                self._store(t, data)
            elif change[:2] == ["SET", "DEFAULT"]:
                column.default = self.expression(rest[i + 3 :])
            elif change[:2] == ["SET", "NOT"]:
                column.not_null = True
                self._check(t, t.data)
            elif change[:2] == ["SET", "NULL"]:
                column.not_null = False
            elif change[:2] == ["DROP", "DEFAULT"]:
                column.default = None
            else:
                j = i + 1 + (2 if change[:2] == ["SET", "DATA"] else 0) + (1 if change[:2] == ["SET", "DATA"] else 0)
                column.kind = Q.spark_type(rest[j:])[0]
                self._store(t, t.data)
        else:
            raise ValueError(f"42581 unexpected token: {rest[0].text}")
        return 0

    def _view(self, items: list[Tok]) -> int:
        at = Q._find(items, "VIEW") + 1
        name, at = self._name(items, at)
        names = None
        if items[at].kind == "g" and items[at + 1].up == "AS":
            names = [Q.render(x).lower() for x in Q.split(items[at].items)]
            at += 1
        rows = self.query(items[at + 1 :])
        (rows.toDF(*names) if names else rows).createOrReplaceTempView(name)
        return 0

    def _sequence_options(self, items: list[Tok], first: int) -> tuple[int, int]:
        start, step = first, 1
        number = lambda i: int(("-" if items[i].text == "-" else "") + items[i + (items[i].text == "-")].text)
        if (i := Q._find(items, "START", "WITH")) >= 0:
            start = number(i + 2)
        if (i := Q._find(items, "INCREMENT", "BY")) >= 0:
            step = number(i + 2)
        return start, step

    def _sequence(self, items: list[Tok]) -> int:
        name, at = self._name(items, 2)
        self.sequences[name] = dml.Sequence(*self._sequence_options(items[at:], 0))
        return 0

    def _function(self, items: list[Tok]) -> int:
        """CREATE FUNCTION f(a type, ..) RETURNS type RETURN expression, as a SQL function of the session."""
        name = items[2].text.lower()
        args = ", ".join(f"{(p[1:] if p[0].up == 'IN' else p)[0].text} {Q.spark_type((p[1:] if p[0].up == 'IN' else p)[1:])[0]}" for p in Q.split(items[3].items) if p)
        at = Q._find(items, "RETURNS")
        body = Q._find(items, "RETURN")
        if items[at + 1].up == "TABLE":
            cols = ", ".join(f"{p[0].text} {Q.spark_type(p[1:])[0]}" for p in Q.split(items[at + 2].items))
            query = items[body + 1 :]
            if query[0].up == "TABLE" and query[1].kind == "g":
                query = query[1].items
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({cols}) RETURN {Q.render(Q.rewrite(query, None))}")
            return 0
        kind, _ = Q.spark_type(items[at + 1 :])
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {self.expression(items[body + 1 :])}")
        return 0

    def _source(self, items: list[Tok]) -> int:
        """SET TABLE t SOURCE 'file;settings': the file's rows become the table's."""
        name, at = self._name(items, 2)
        t = self.tables[name]
        source = next(x for x in items[at:] if x.kind in "sq").text[1:-1].replace("''", "'")
        schema = ", ".join(f"`{c.name}` {c.kind}" for c in t.columns)
        self._store(t, text.read_text_table(self.spark, schema, text.TextSettings.parse(source)))
        return 0

    def _export(self, items: list[Tok]) -> int:
        """PERFORM EXPORT DATA FROM TABLE t TO 'file;settings'"""
        name, at = self._name(items, Q._find(items, "TABLE") + 1)
        text.write_text_table(self._table(name).data.drop(RID), text.TextSettings.parse(items[at + 1].text[1:-1].replace("''", "'")))
        return 0

    def _import(self, items: list[Tok]) -> int:
        """PERFORM IMPORT DATA INTO TABLE t FROM 'file;settings' [{CONTINUE | STOP | CHECK} ON ERROR]"""
        name, at = self._name(items, Q._find(items, "TABLE") + 1)
        t = self._table(name)
        mode = items[at + 2].up if at + 2 < len(items) else "STOP"
        schema = ", ".join(f"`{c.name}` {c.kind}" for c in t.columns)
        rows = stage(text.read_text_table(self.spark, schema, text.TextSettings.parse(items[at + 1].text[1:-1].replace("''", "'")), on_error=mode), name)
        self._store(t, t.data.drop(RID).unionByName(rows))
        return rows.count()

    def _import_script(self, items: list[Tok]) -> int:
        source = next(x for x in items if x.kind == "s").text[1:-1]
        lines = self.spark.read.text(source, wholetext=True).collect()  # a script is text for the driver, not data
        return sum(len(self.script(r[0])) for r in lines)

    def dump(self) -> DataFrame:
        """SCRIPT: definitions and data as statements, a row each; the data's lines are made on the executors."""
        out = None
        for n, t in enumerate(self.tables.values()):
            cells = [f"{c.name} {c.kind.upper()}{f' DEFAULT {c.default}' if c.default else ''}{' NOT NULL' if c.not_null else ''}" for c in t.columns]
            cells += [f"PRIMARY KEY ({', '.join(t.key)})"] if t.key else []
            cells += [f"UNIQUE ({', '.join(u)})" for u in t.unique] + [f"CHECK ({c})" for c in t.checks.values()]
            cells += [f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.parent} ({', '.join(f.target)}) ON DELETE {f.on_delete}" for f in t.foreign]
            head = self.spark.createDataFrame([(n, 0, f"CREATE TABLE {t.name} ({', '.join(cells)})")], "t int, part int, statement string")
            values = [F.when(F.col(c.name).isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c.name).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if c.kind in ("string", "date") or c.kind.startswith("timestamp") else F.col(c.name).cast("string")) for c in t.columns]
            rows = t.data.select(F.lit(n).alias("t"), F.lit(1).alias("part"), F.concat(F.lit(f"INSERT INTO {t.name} VALUES ("), F.concat_ws(", ", *values), F.lit(")")).alias("statement"))
            out = head.unionByName(rows) if out is None else out.unionByName(head).unionByName(rows)
        return out.orderBy("t", "part", "statement").select("statement") if out is not None else self.spark.createDataFrame([], "statement string")

    # --- changes

    def _table(self, name: str) -> TableDef:
        if name not in self.tables:
            raise ValueError(f"42501 user lacks privilege or object not found: {name}")
        return self.tables[name]

    def _insert(self, items: list[Tok]) -> int:
        ignore = items[1].up == "IGNORE"
        name, at = self._name(items, 3 if ignore else 2)
        t = self._table(name)
        on = Q._find(items, "ON", "DUPLICATE", "KEY", "UPDATE")
        items, instead = (items[:on], items[on + 4 :]) if on > 0 else (items, None)
        names = [c.name for c in t.columns if not c.generated]
        if at < len(items) and items[at].kind == "g" and not Q._is_query(items[at]):
            names, at = [Q.render(x).strip("`").lower() for x in Q.split(items[at].items)], at + 1
        while at < len(items) and items[at].up in ("OVERRIDING", "SYSTEM", "USER", "VALUE"):
            at += 1
        kinds = {c.name: c for c in t.columns}
        for n in names:
            if n not in kinds:
                raise ValueError(f"42501 user lacks privilege or object not found: {n}")
        if items[at].up == "DEFAULT":
            rows, names = self.spark.range(1).select(), []
        elif items[at].up == "VALUES":
            groups = [g.items for g in items[at + 1 :] if g.kind == "g"]
            lines = []
            for n_line, g in enumerate(groups):
                values = Q.split(g)
                if len(values) != len(names):
                    raise ValueError("42546 column count does not match")
                cells = [(kinds[n].default or "NULL") if Q.render(v).upper() == "DEFAULT" else self.expression(self._with_sequences(v)) for n, v in zip(names, values, strict=True)]
                lines.append("SELECT " + ", ".join(f"CAST({c} AS {kinds[n].kind}) AS `{n}`" for n, c in zip(names, cells, strict=True)) + f", {n_line} AS rq_line")
            # identity values go by the order of the lines
            rows = self.spark.sql(" UNION ALL ".join(lines)).repartition(1).sortWithinPartitions("rq_line").drop("rq_line")
        else:
            rows = self.query(items[at:])
            if len(rows.columns) != len(names):
                raise ValueError("42546 column count does not match")
            rows = rows.toDF(*names)
        for c in t.columns:
            if c.identity is None:
                continue
            if c.name not in names:
                rows = stage(rows, name)
                rows = c.identity.numbered(rows, c.name)
            else:
                rows = stage(rows, name)
                nulls = rows.where(F.col(c.name).isNull())
                if not nulls.isEmpty():
                    rows = rows.where(F.col(c.name).isNotNull()).unionByName(c.identity.numbered(nulls.drop(c.name), c.name).select(*rows.columns))
                top = rows.agg(F.max(c.name)).first()[0]
                if top is not None and top >= (c.identity.next_value if c.identity.next_value is not None else c.identity.start):
                    c.identity.next_value = int(top) + c.identity.increment
                    c.identity.last = int(top)
            self.last_identity = c.identity.last
        defaults = {c.name: F.expr(c.default) for c in t.columns if c.default}
        for c in t.columns:
            if c.name not in rows.columns and not c.generated:
                rows = rows.withColumn(c.name, defaults.get(c.name, F.lit(None)).cast(c.kind))
        for c in t.columns:
            if c.generated:
                rows = rows.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        rows = rows.select(*[F.col(c.name).cast(c.kind).alias(c.name) for c in t.columns])
        if t.versioned:
            rows = stage(self._stamped(t, rows), name)
        if any(g.table == t.name and g.event == "INSERT" for g in self.triggers.values()):
            rows = stage(self._fire(t, True, "INSERT", rows, None), name)
        old = t.data.drop(RID)
        n = None
        if items[0].up == "REPLACE" and t.key:
            rows = stage(rows, name)
            old = old.join(rows.select(*t.key), t.key, "left_anti").select(*t.names)
        elif (ignore or instead is not None) and t.key:
            rows = stage(rows, name)
            met = rows.join(old.select(*t.key), t.key, "left_semi").select(*t.names)
            rows = stage(rows.join(old.select(*t.key), t.key, "left_anti").select(*t.names).dropDuplicates(t.key), name)
            n = rows.count()
            if instead is not None:
                old, more = self._instead(t, old, met, instead)
                n += more
        n = rows.count() if n is None else n
        self._store(t, old.unionByName(rows))
        self._children_hold(t)
        self._fire(t, False, "INSERT", rows, None)
        return n

    def _instead(self, t: TableDef, old: DataFrame, met: DataFrame, items: list[Tok]) -> tuple[DataFrame, int]:
        """ON DUPLICATE KEY UPDATE: ``old`` with the cells set where ``met`` has its key; VALUES(c) is the new row's cell."""
        kinds = {c.name: c.kind for c in t.columns}
        both = old.join(met.dropDuplicates(t.key).select(*[F.col(c).alias(f"rq_new_{c}") for c in t.names], F.lit(True).alias("rq_met")), [F.col(k) == F.col(f"rq_new_{k}") for k in t.key], "left")
        cells = {}
        for part in Q.split(items):
            eq = next(i for i, x in enumerate(part) if x.text == "=" and x.kind == "o")
            value, i = [], eq + 1
            while i < len(part):
                if part[i].up == "VALUES" and i + 1 < len(part) and part[i + 1].kind == "g":
                    value, i = [*value, Tok("w", f"rq_new_{Q.render(part[i + 1].items).lower()}")], i + 2
                else:
                    value, i = [*value, part[i]], i + 1
            name = Q.render(part[eq - 1 : eq]).strip("`").lower()
            cells[name] = F.when(F.col("rq_met"), F.expr(self.expression(value)).cast(kinds[name])).otherwise(F.col(name)).alias(name)
        return both.select(*[cells.get(c, F.col(c)) for c in t.names]), met.select(*t.key).distinct().count()

    def _children_hold(self, t: TableDef) -> None:
        """Raises where a row of another table has lost the row of ``t`` that its foreign key names."""
        for child in self.tables.values():
            if child is not t and any(f.parent == t.name for f in child.foreign):
                self._check(child, dml.current_rows(child.data, child.period[1]) if child.versioned else child.data)

    def _repoint(self, t: TableDef, old: DataFrame, new: DataFrame) -> None:
        """What foreign keys ask for when keys of their parent ``t`` change. ``old`` and ``new`` are the changed rows, by number."""
        for child in list(self.tables.values()):
            for f in [f for f in child.foreign if f.parent == t.name and child is not t and f.on_update not in ("NO ACTION", "RESTRICT")]:
                a = old.select(RID, *[F.col(c).alias(f"rq_o{i}") for i, c in enumerate(f.target)])
                b = new.select(RID, *[F.col(c).alias(f"rq_n{i}") for i, c in enumerate(f.target)])
                differs = " OR ".join(f"NOT (rq_o{i} <=> rq_n{i})" for i in range(len(f.target)))
                moved = stage(a.join(b, RID).where(differs).drop(RID), t.name)
                if moved.isEmpty():
                    continue
                kinds = {c.name: c for c in child.columns}
                same = [F.col(c) == F.col(f"rq_o{i}") for i, c in enumerate(f.columns)]
                hit = child.data.join(moved, same)
                value = {
                    c: F.col(f"rq_n{i}") if f.on_update == "CASCADE" else F.expr(kinds[c].default) if f.on_update == "SET DEFAULT" and kinds[c].default else F.lit(None)
                    for i, c in enumerate(f.columns)
                }
                after = stage(hit.select(RID, *[(value[c].cast(kinds[c].kind) if c in value else F.col(c)).alias(c) for c in child.names]), child.name)
                before = child.data
                self._store(child, before.join(after.select(RID), RID, "left_anti").unionByName(after.select(*before.columns)).drop(RID))
                self._repoint(child, before.join(after.select(RID), RID, "left_semi"), after)

    def _stamped(self, t: TableDef, rows: DataFrame) -> DataFrame:
        """``rows`` as current versions from now on."""
        kind = {c.name: c.kind for c in t.columns}
        a, b = t.period
        return rows.withColumns({a: F.current_timestamp().cast(kind[a]), b: F.lit(dml.FOREVER).cast(kind[b])})

    def _ended(self, t: TableDef, rows: DataFrame) -> DataFrame:
        """``rows`` as versions that end now."""
        kind = {c.name: c.kind for c in t.columns}
        return rows.withColumn(t.period[1], F.current_timestamp().cast(kind[t.period[1]]))

    def _hits(self, t: TableDef, alias: str, where: list[Tok] | None, cells: dict[str, str]) -> DataFrame:
        """The rows that a condition holds for, with their numbers and new values."""
        (dml.current_rows(t.data, t.period[1]) if t.versioned else t.data).createOrReplaceTempView("rq_target")
        columns = ", ".join(f"CAST(({cells[c.name]}) AS {c.kind}) AS `{c.name}`" if c.name in cells else f"`{alias}`.`{c.name}`" for c in t.columns)
        condition = f" WHERE {Q.render(Q.rewrite(where, None))}" if where else ""
        return stage(self.spark.sql(f"SELECT {columns}, `{alias}`.{RID} FROM rq_target AS `{alias}`{condition}"), t.name)

    def _target(self, items: list[Tok], at: int) -> tuple[TableDef, str, int]:
        name, at = self._name(items, at)
        alias = name
        if at < len(items) and items[at].up == "AS":
            alias, at = items[at + 1].text, at + 2
        elif at < len(items) and items[at].kind == "w" and items[at].up not in ("SET", "WHERE", "USING", "LIMIT"):
            alias, at = items[at].text, at + 1
        return self._table(name), alias, at

    def _update(self, items: list[Tok]) -> int:
        t, alias, at = self._target(items, 1)
        if items[at].up != "SET":
            raise ValueError(f"42581 unexpected token: {items[at].text}")
        end = Q._find(items, "WHERE")
        cells: dict[str, str] = {}
        for part in Q.split(items[at + 1 : end if end >= 0 else len(items)]):
            eq = next(i for i, x in enumerate(part) if x.text == "=" and x.kind == "o")
            left, right = part[:eq], part[eq + 1 :]
            if left[0].kind == "g":
                pairs = zip([Q.render(x) for x in Q.split(left[0].items)], Q.split((right[1] if right[0].up == "ROW" else right[0]).items), strict=True)
            else:
                pairs = [(Q.render(left[-1:]), right)]
            for name, value in pairs:
                c = next((c for c in t.columns if c.name == name.strip("`").lower()), None)
                if c is None:
                    raise ValueError(f"42501 user lacks privilege or object not found: {name}")
                cells[c.name] = (c.default or "NULL") if Q.render(value).upper() == "DEFAULT" else Q.render(Q.rewrite(value, lambda _s, e: self.types(f"SELECT %s FROM `{t.name}` AS `{alias}`", e)))
        changed = self._hits(t, alias, items[end + 1 :] if end >= 0 else None, cells)
        for c in t.columns:
            if c.generated:
                changed = changed.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        n = changed.count()
        rest = t.data.join(changed.select(RID), RID, "left_anti")
        watched = any(g.table == t.name and g.event == "UPDATE" for g in self.triggers.values())
        named = any(f.parent == t.name for c in self.tables.values() if c is not t for f in c.foreign)
        old = t.data.join(changed.select(RID), RID, "left_semi") if watched or t.versioned or named else None
        if watched:
            changed = stage(self._fire(t, True, "UPDATE", changed, old), t.name)
        if t.versioned:
            changed = stage(self._stamped(t, changed), t.name)
            rest = rest.unionByName(self._ended(t, old).select(*rest.columns))
        self._store(t, rest.unionByName(changed.select(*rest.columns)).drop(RID))
        if named:
            self._repoint(t, old, changed)
            self._children_hold(t)
        if watched:
            self._fire(t, False, "UPDATE", changed, old)
        return n

    def _delete(self, items: list[Tok]) -> int:
        t, alias, at = self._target(items, 2)
        most = Q._find(items, "LIMIT", start=at)
        rest, most = (items[:most], int(items[most + 1].text)) if most >= 0 else (items, 0)
        where = Q._find(rest, "WHERE")
        gone = self._hits(t, alias, rest[where + 1 :] if where >= 0 else None, {})
        if most:  # 0 is no limit
            gone = stage(gone.orderBy(RID).limit(most), t.name)
        n = gone.count()
        self._fire(t, True, "DELETE", None, gone)
        self._remove(t, gone)
        self._fire(t, False, "DELETE", None, gone)
        return n

    def _remove(self, t: TableDef, gone: DataFrame) -> None:
        """Rows go from a table, and what their foreign keys ask for happens to its children first."""
        self._orphan(t, gone)
        left = t.data.join(gone.select(RID), RID, "left_anti")
        if t.versioned:
            left = left.unionByName(self._ended(t, gone).select(*left.columns))
        self._store(t, left.drop(RID))

    def _orphan(self, t: TableDef, gone: DataFrame) -> None:
        """What foreign keys ask for when rows of their parent ``t`` go."""
        for child in list(self.tables.values()):
            for f in child.foreign:
                if f.parent != t.name:
                    continue
                defaults = {c.name: F.expr(c.default) for c in child.columns if c.default}
                if f.on_delete == "CASCADE" and child is not t:
                    keys = gone.select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(f.target)]).distinct()
                    lost = child.data.join(keys, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(f.columns)], "left_semi")
                    self._remove(child, stage(lost, child.name))
                else:
                    still = t.data.join(gone.select(RID), RID, "left_anti") if child is t else child.data
                    after = dml.on_parent_delete(still, f.columns, gone, f.target, f.on_delete, defaults)
                    if child is not t and after is not child.data:
                        saved, child.foreign = child.foreign, [x for x in child.foreign if x is not f]
                        self._store(child, after.drop(RID))
                        child.foreign = saved

    def _truncate(self, items: list[Tok]) -> int:
        t = self._table(self._name(items, 2)[0])
        if Q._find(items, "RESTART", "IDENTITY") >= 0:
            for c in t.columns:
                if c.identity:
                    c.identity.next_value = None
        self._remove(t, t.data)
        return 0

    def _merge(self, items: list[Tok]) -> int:
        """MERGE INTO t [AS a] USING s [AS b] ON .. WHEN ..: the first branch that holds decides; a table row met twice raises."""
        t, alias, at = self._target(items, 2)
        source = items[at + 1 : (on := Q._find(items, "ON", start=at))]
        whens = [i for i in range(on, len(items)) if items[i].up == "WHEN" and items[i + 1].up in ("MATCHED", "NOT")]
        condition = Q.render(Q.rewrite(items[on + 1 : whens[0]], None))
        src = Q.render(Q.rewrite(source, self.types))
        t.data.createOrReplaceTempView("rq_target")
        branches = []
        for i, a in enumerate(whens):
            part = items[a : whens[i + 1] if i + 1 < len(whens) else len(items)]
            then = Q._find(part, "THEN")
            matched = part[1].up == "MATCHED"
            extra = part[(3 if matched else 4) : then]
            branches.append((matched, Q.render(Q.rewrite(extra, None)) if extra else "TRUE", part[then + 1 :]))
        names = {c.name: c for c in t.columns}

        def cell(name: str, value: list[Tok]) -> str:
            return f"CAST(({names[name].default or 'NULL'}) AS {names[name].kind})" if Q.render(value).upper() == "DEFAULT" else f"CAST(({Q.render(Q.rewrite(value, None))}) AS {names[name].kind})"

        whole = {c.name: f"`{alias}`.`{c.name}`" for c in t.columns}
        picks, columns = [], {c: [] for c in names}
        inserts = []
        for n, (matched, test, action) in enumerate(branches):
            if matched:
                picks.append(f"WHEN {test} THEN {n}")
                if action[0].up == "UPDATE":
                    for part in Q.split(action[2:]):
                        eq = next(i for i, x in enumerate(part) if x.text == "=")
                        name = Q.render(part[eq - 1 : eq]).strip("`").lower()
                        columns[name].append((n, cell(name, part[eq + 1 :])))
            else:
                at_values = Q._find(action, "VALUES")
                given = [Q.render(x).lower() for x in Q.split(action[1].items)] if action[1].kind == "g" else t.names
                values = Q.split(action[at_values + 1].items)
                cells = dict(zip(given, [cell(g, v) for g, v in zip(given, values, strict=True)], strict=True))
                inserts.append((test, cells))
        hits = None
        if picks:
            branch = f"CASE {' '.join(picks)} ELSE -1 END"
            body = ", ".join(f"CASE {branch} {' '.join(f'WHEN {n} THEN {v}' for n, v in columns[c])} ELSE {whole[c]} END AS `{c}`" if columns[c] else f"{whole[c]} AS `{c}`" for c in names)
            hits = self.spark.sql(f"SELECT {body}, {branch} AS rq_b, `{alias}`.{RID} FROM rq_target AS `{alias}` JOIN {src} ON {condition}")
            hits = stage(hits.where("rq_b >= 0"), t.name)
            if not hits.groupBy(RID).count().where("count > 1").isEmpty():
                raise ValueError("21000 cardinality violation: a row of the target matches twice")
        new = []
        taken = "FALSE"
        for test, cells in inserts:
            body = ", ".join(f"{cells.get(c, f'CAST(({names[c].default or "NULL"}) AS {names[c].kind})')} AS `{c}`" for c in names)
            new.append(self.spark.sql(f"SELECT {body} FROM {src} LEFT ANTI JOIN rq_target AS `{alias}` ON {condition} WHERE ({test}) AND NOT coalesce({taken}, FALSE)"))
            taken = f"({taken} OR ({test}))"
        added = [stage(x, t.name) for x in new]
        n = sum(x.count() for x in added)
        out = t.data
        if hits is not None:
            n += hits.count()
            deletes = [i for i, (m, _, a) in enumerate(branches) if m and a[0].up == "DELETE"]
            kept = hits.where(~F.col("rq_b").isin(deletes)) if deletes else hits
            if deletes:
                lost = hits.where(F.col("rq_b").isin(deletes)).select(RID)
                self._orphan(t, stage(t.data.join(lost, RID, "left_semi"), t.name))
            before = t.data.join(kept.select(RID), RID, "left_semi")
            out = out.join(hits.select(RID), RID, "left_anti").unionByName(kept.drop("rq_b"))
        out = out.drop(RID)
        for x in added:
            out = out.unionByName(x)
        self._store(t, out)
        if hits is not None:
            self._repoint(t, before, kept.drop("rq_b"))
        self._children_hold(t)
        return n

    def information_schema(self, name: str) -> DataFrame:
        return dml.information_schema(self.spark, name)
