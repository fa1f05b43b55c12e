"""Consistency checks that read each commit once.

The ledger keeps what a check needs of the commits it has seen: sums that add up (rows, first and last
order date, faulty values), the references whose key no commit holds yet, and a filter of the keys
each commit does hold. An update reads the new commits only. A new key closes the open references to it,
however late it comes. A new reference is settled by its own commit or by an open reference to the
same key; only for the rest are stored keys read, and only in commits whose filter names them.
The result equals ``integrity_checks`` on the whole store.

A state is written under a number of its own, and one row, written last, makes it the current one; a
failed update is repeated under the same number. When commits have gone (a compaction, a
bulk load) the ledger begins anew. One writer at a time is assumed, as in the store.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.operators.integrity import ORPHAN_CHECKS, RESULT_COLUMNS, _holders, _references, range_text
from tillmart.operators.staging import remove_path, stage, staging_scope
from tillmart.schemas import STAR_SCHEMAS
from tillmart.sources.key_index import BITS_PER_KEY, FILTERS, build_filters, commits_for, key_hash
from tillmart.sources.store import BROADCAST_COMMITS, COMMIT, StarStore

# Up to this many keys are looked up by their hashes in the commits' filters; more are joined with all stored keys.
PROBED_KEYS = 50_000
# Up to this many (commit, hash) hits, some 100 bytes each, are broadcast to the stored keys.
BROADCAST_HITS = 500_000

TABLES = {
    "commits": f"{COMMIT} string",
    "open": "check int, key string, used bigint",
    "figures": "part string, rows bigint, first date, last date, no_sales bigint, bad_quantity bigint, held int, null_held int",
    "filters": FILTERS,
    "current": "number bigint, base bigint",
}
_MERGED = {
    "rows": F.sum, "first": F.min, "last": F.max, "no_sales": F.sum, "bad_quantity": F.sum, "held": F.max, "null_held": F.max,
}


class IntegrityLedger:
    def __init__(self, store: StarStore, bits_per_key: float = BITS_PER_KEY):
        self.store, self.spark, self.path = store, store.spark, f"{store.path}/integrity"
        self.bits_per_key = bits_per_key

    def _read(self, table: str, folder: str = "") -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[table])

    def _current(self) -> Row | None:
        return self._read("current").orderBy(F.desc("number")).first()

    def _state(self, table: str, state: Row | None) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table]) if state is None else self._read(table, f"/state={state.number}")

    def _filters(self, state: Row) -> DataFrame:
        """Filters of all commits since the ledger last began; each state adds those of its own."""
        rows = self.spark.read.schema(f"{FILTERS}, state bigint").parquet(f"{self.path}/filters")
        return rows.where(F.col("state").between(state.base, state.number)).drop("state")

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        schema = T.StructType.fromDDL(TABLES[table])
        typed = rows.select(*[F.col(column.name).cast(column.dataType) for column in schema])
        typed.write.mode("overwrite").parquet(f"{self.path}/{table}/state={number}")

    def update(self) -> Row:
        """Take in the commits since the last call; returns the current state's row."""
        last = self._current()
        commits = self.store.commit_keys()
        seen, number = self._state("commits", last), last.number + 1 if last else 1
        known, base = last, last.base if last else number
        if last and not seen.join(commits, COMMIT, "left_anti").isEmpty():
            known, base = None, number
            seen = self._state("commits", None)
        with staging_scope(self.spark):
            new = stage(commits.join(seen, COMMIT, "left_anti"), "new-commits")
            count = new.count()
            if known and not count:
                return last
            few = count * len(ORPHAN_CHECKS) <= BROADCAST_COMMITS
            self._take_in(F.broadcast(new) if few else new, few, known, number)
            self._write(seen.unionByName(new), "commits", number)
            self._write(self.spark.createDataFrame([(number, base)], TABLES["current"]), "current", number)
        if last:
            self._remove_old(last, base)
        return self._current()

    def _take_in(self, new: DataFrame, few: bool, known: Row | None, number: int) -> None:
        rows = {name: self.store.written(name, new) for name in STAR_SCHEMAS}
        per_key = stage(self._per_key(rows, self._state("open", known)), "new-keys")
        unsettled = per_key.where("key IS NOT NULL AND held = 0")
        asked = stage(unsettled.where("before = 0").select("check", "key"), "new-references")
        still = unsettled.select("check", "key", (F.col("used") + F.col("before")).alias("used"))
        if known:
            found = self._held_earlier(asked, known)
            still = still if found is None else still.join(found, ["check", "key"], "left_anti")
        self._write(still, "open", number)
        figures = self._figures(rows, per_key).unionByName(self._state("figures", known))
        self._write(figures.groupBy("part").agg(*[merge(name).alias(name) for name, merge in _MERGED.items()]), "figures", number)
        held = [
            rows[parent].select(COMMIT, F.lit(check).alias("check"), F.col(key).alias("key")).where("key IS NOT NULL")
            for check, (_, _, _, key, parent) in ORPHAN_CHECKS.items()
        ]
        # Staged, as the sizes of the filters and their marks both read them: else the keys are made distinct twice.
        keys = stage(reduce(DataFrame.unionByName, held).distinct(), "held-keys")
        self._write(build_filters(keys, self.bits_per_key, few), "filters", number)

    @staticmethod
    def _per_key(rows: dict[str, DataFrame], opened: DataFrame) -> DataFrame:
        """(check, key, used, held, before): new references, whether a new row has the key, open references."""
        referring: dict[str, dict[int, str]] = {}
        stacked = []
        for check, (_, _, child, key, parent) in ORPHAN_CHECKS.items():
            referring.setdefault(child, {})[check] = key
            stacked.append(_holders(rows[parent], {check: key}, T.StringType()))
        stacked += [_references(rows[child], columns, T.StringType()) for child, columns in referring.items()]
        stacked = [part.withColumn("before", F.lit(0).cast("bigint")) for part in stacked]
        stacked.append(opened.select("check", "key", F.lit(0).alias("used"), F.lit(0).alias("held"), F.col("used").alias("before")))
        per_key = reduce(DataFrame.unionByName, stacked).groupBy("check", "key")
        return per_key.agg(F.sum("used").alias("used"), F.max("held").alias("held"), F.sum("before").alias("before"))

    def _held_earlier(self, asked: DataFrame, known: Row) -> DataFrame | None:
        """(check, key) of the asked keys that commits before the new ones hold; None when nothing is asked."""
        number = asked.count()
        if not number:
            return None
        seen = self._state("commits", known)
        hits = hits_hint = None
        if number <= PROBED_KEYS:
            hits = stage(commits_for(self._filters(known), asked), "hits")
            hits_hint = F.broadcast if hits.count() <= BROADCAST_HITS else lambda rows: rows
        stored = []
        for check, (_, _, _, key, parent) in ORPHAN_CHECKS.items():
            if hits is None:
                rows = self.store.written(parent, seen)
            else:
                own = hits.where(F.col("check") == check).select(COMMIT, "hash")
                rows = self.store.written(parent, hits_hint(own.select(COMMIT).distinct()))
                rows = rows.withColumn("hash", key_hash(F.col(key))).join(hits_hint(own), [COMMIT, "hash"], "left_semi")
            stored.append(rows.select(F.lit(check).alias("check"), F.col(key).alias("key")))
        return asked.join(reduce(DataFrame.unionByName, stored), ["check", "key"], "left_semi")

    @staticmethod
    def _figures(rows: dict[str, DataFrame], per_key: DataFrame) -> DataFrame:
        """Sums of the new commits, one row per table and per check; others' columns stay null."""
        extra = {
            "orders": {"first": F.min("order_date"), "last": F.max("order_date")},
            "order_items": {
                "no_sales": F.count_if(F.col("sales").isNull() | (F.col("sales") == 0)),
                "bad_quantity": F.count_if(F.col("quantity") <= 0),
            },
        }
        schema = T.StructType.fromDDL(TABLES["figures"])

        def part(name: str, sums: DataFrame) -> DataFrame:
            columns = [F.col(c.name) if c.name in sums.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in schema.fields[1:]]
            return sums.select(F.lit(name).alias("part"), *columns)

        parts = [
            part(name, table.agg(F.count(F.lit(1)).alias("rows"), *[value.alias(column) for column, value in extra.get(name, {}).items()]))
            for name, table in rows.items()
        ]
        for check, (name, *_) in ORPHAN_CHECKS.items():
            sums = per_key.where(F.col("check") == check).agg(
                F.sum("used").alias("rows"), F.max("held").alias("held"), F.max(F.when(F.col("key").isNull(), F.col("held"))).alias("null_held")
            )
            parts.append(part(name, sums))
        return reduce(DataFrame.unionByName, parts)

    def _remove_old(self, last: Row, base: int) -> None:
        """Delete the state before the current one, and filters of commits that have gone."""
        for table in ("commits", "open", "figures", "current"):
            remove_path(self.spark, f"{self.path}/{table}/state={last.number}")
        for number in range(last.base, min(base, last.number + 1)):
            remove_path(self.spark, f"{self.path}/filters/state={number}")

    def checks(self) -> DataFrame:
        """name, desc, count and severity, as ``integrity_checks`` gives them for the whole store."""
        state = self.update()
        figures, opened = self._state("figures", state), self._state("open", state)

        def of(part: str, column: str):
            return F.max(F.when(F.col("part") == part, F.col(column)))

        def number(part: str, column: str):
            return F.coalesce(of(part, column), F.lit(0)).cast("bigint")

        missing = opened.join(
            self.spark.createDataFrame([(check, name) for check, (name, *_) in ORPHAN_CHECKS.items()], "check int, part string"), "check"
        ).groupBy("part").agg(F.sum("used").alias("missing"))
        rows = []
        for name, desc, *_ in ORPHAN_CHECKS.values():
            count = F.when(number(name, "held") == 0, number(name, "rows")).when(number(name, "null_held") == 1, 0).otherwise(number(name, "missing"))
            rows.append((F.lit(name), F.lit(desc), count, F.lit("critical")))
        dates = range_text(of("orders", "first"), of("orders", "last"), number("orders", "rows"))
        rows.append((F.lit("Date Range"), dates, F.lit(0), F.lit("info")))
        rows.append((F.lit("Zero/Null Sales"), F.lit("Line items with no revenue value"), number("order_items", "no_sales"), F.lit("warning")))
        rows.append((F.lit("Bad Quantities"), F.lit("Line items with zero or negative qty"), number("order_items", "bad_quantity"), F.lit("warning")))
        sizes = [F.concat(F.lit(f"{name}: "), F.format_number(number(name, "rows"), 0)) for name in STAR_SCHEMAS]
        rows.append((F.lit("Table Sizes"), F.concat_ws(" · ", *sizes), F.lit(0), F.lit("info")))
        entries = [F.struct(name.alias("name"), desc.alias("desc"), count.cast("bigint").alias("count"), level.alias("severity")) for name, desc, count, level in rows]
        return figures.join(missing, "part", "left").agg(F.array(*entries).alias("rows")).select(F.inline("rows")).select(*RESULT_COLUMNS)
