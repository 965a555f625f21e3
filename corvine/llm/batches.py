"""Problem 4: checking new batches against everything accepted before.

The accepted history lives in an index of three growing tables: file hashes,
distinct chunk sets, and postings of each set's rare-token prefix in folders by
token. A batch probes the postings with its own prefixes, filters by length and
position, verifies the overlap, settles what its own entries mean for each
other (a small batch in one task, a large one in rounds), and appends what was
accepted. Batches go one after another; the history's entries are never read
again.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import bounded, materialize, read_table, shared_dir

#: Share of common chunk hashes from which two entries are near duplicates.
SHARE = 0.5
#: Folders into which postings go by token (at most 63), and the size of a batch up to which it is broadcast.
PARTS, BROADCAST_BYTES = 16, 32 << 20

_ACC = "acc struct<batch_id:int,entry_id:bigint>"
_SETTLED = pa.schema({"batch_id": pa.int32(), "entry_id": pa.int64(), "coll": pa.string(), "fh": pa.string(), "sid": pa.int64(), "toks": pa.list_(pa.int64()), "match_id": pa.int64(), "how": pa.string(), "taken": pa.bool_()})


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def hexadecimal(c: Column) -> Column:
    """A hash as a plain hexadecimal value: no scheme in front, lower case, no
    spaces, no leading zeros; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*(?:[a-z0-9_-]+:|0x)", ""), r"[^0-9a-f]", "")
    return F.when(bare != "", F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0")))


def entries(registry: DataFrame) -> DataFrame:
    """``(batch_id, entry_id, coll, fh, toks, sid, at)`` with each replayed row
    once; ``at`` is its place in the order of arrival.

    ``toks`` has the distinct chunk hashes as 64-bit values, null where the
    entry has none. Of rows sharing an entry_id the one with chunk hashes wins.
    """
    hashes = F.map_values(F.from_json("chunk_hashes", "map<string,string>"))
    toks = F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(hashes, hexadecimal), lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    e = registry.filter("entry_id is not null and batch_id is not null").select(
        F.col("batch_id").cast("int").alias("batch_id"), "entry_id", F.coalesce(F.col("collection_id"), F.lit("\u0000")).alias("coll"), hexadecimal(F.col("file_hash")).alias("fh"), F.when(F.size(toks) > 0, toks).alias("toks")
    )
    one = e.groupBy("entry_id").agg(F.min(F.struct("batch_id", F.col("toks").isNull().alias("none"), F.coalesce("fh", F.lit("")).alias("f"), "coll", "fh", "toks")).alias("x"))
    e = one.select("x.batch_id", "entry_id", "x.coll", "x.fh", "x.toks").withColumn("sid", F.when(F.col("toks").isNotNull(), F.xxhash64("coll", "toks")))
    return e.withColumn("at", F.struct("batch_id", "entry_id"))


def settler(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Settles a whole batch in one task, entry by entry in the order of arrival.

    Takes the entries with ``e``, the history's entry of their file, and ``o``, its
    best set; gives ``_SETTLED``. Among themselves sets meet by prefixes in the
    order of the batch's own counts: a token new to the history may be in all of it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for part in parts for r in part.to_pylist()), key=lambda r: (r["batch_id"], r["entry_id"]))
        count = Counter(t for r in rows for t in r["toks"] or ())
        place = lambda acc: (acc["batch_id"], acc["entry_id"])
        files: dict[tuple, tuple] = {}
        sets: list[tuple[frozenset, tuple]] = []
        heads: dict[tuple, list[int]] = defaultdict(list)
        for r in rows:
            at, coll, toks = place(r), r["coll"], r["toks"] or []
            n, whole = len(toks), frozenset(toks)
            rare = sorted(toks, key=lambda t: (count[t], t))[: n - math.ceil(n * share - 1e-9) + 1]
            head = [(coll, t) for t in rare if count[t] > 1]
            file = [place(r["e"])] if r["e"] else []
            if r["fh"] is not None and (coll, r["fh"]) in files:
                file.append(files[coll, r["fh"]])
            near = [(r["o"]["s"], place(r["o"]["acc"]))] if r["o"] else []
            for k in {k for h in head for k in heads.get(h, ())}:
                other, acc = sets[k]
                if min(n, len(other)) >= max(n, len(other)) * share - 1e-9:
                    both = len(whole & other)
                    alike = both / (n + len(other) - both)
                    near += [(-alike, acc)] * (alike >= share)
            r["taken"] = not file and not near
            if r["taken"]:
                if r["fh"] is not None:
                    files[coll, r["fh"]] = at
                if n:
                    for h in head:
                        heads[h].append(len(sets))
                    sets.append((whole, at))
            exact = bool(file) and min(file) < at
            best = min(file) if exact else min((x for x in near if x[1] < at), default=(0, None))[1]
            r["match_id"], r["how"] = (best[1], "exact" if exact else "near") if best else (None, None)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SETTLED)

    return run


class BatchIndex:
    """The accepted history in a folder. ``build`` takes the first of it, ``step``
    a batch, ``open`` goes on with a folder of before.

    The folder has generations, one for each call of ``build`` or ``step``, each
    with three tables: ``files`` (least entry of a file hash), ``sets`` (distinct
    chunk sets) and ``posts``, the postings of the sets' rare-token prefixes in
    ``parts`` folders by token. A generation counts once its mark is in ``done``.
    A step reads the folders its tokens are in and joins them with its own rows,
    which are broadcast if small; the history is never shuffled and never
    written again.

    Tokens are ordered by their number of sets in the first history, rarest
    first; that order never changes, so prefixes stay comparable for ever.
    """

    def __init__(self, spark: SparkSession, share: float = SHARE, path: str | None = None, parts: int = PARTS):
        self.spark, self.share, self.parts = spark, share, parts
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.done: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BatchIndex:
        """The index in a folder, with all generations that were completed."""
        p, fs = _hadoop(spark, f"{path}/done")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p))
        share, parts = names[0].split("_")[1:]
        index = cls(spark, float(share), path, int(parts))
        index.done = names
        return index

    def _table(self, name: str, schema: str) -> DataFrame:
        """All completed generations of a table, as one scan."""
        there = self.spark.read.schema(f"{schema}, gen string").parquet(f"{self.path}/{name}")
        return there.filter(F.col("gen").isin(self.done)).drop("gen")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("coll", "tok"), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, name: str, generation: str, small: bool) -> None:
        to = f"{self.path}/{name}/gen={generation}"
        if "tok" not in df.columns:
            return df.write.mode("overwrite").parquet(to)
        df = df.withColumn("part", self._part())
        return (df if small else df.repartition("part")).sortWithinPartitions("part", "tok").write.mode("overwrite").partitionBy("part").parquet(to)

    def build(self, history: DataFrame) -> None:
        """Accept every entry of ``history`` without a check."""
        sets = materialize(history.filter("sid is not null").groupBy("coll", "sid").agg(F.first("toks").alias("toks"), F.min("at").alias("acc")), "sets")
        tokens = sets.select("coll", F.explode("toks").alias("tok")).groupBy("coll", "tok").count().filter("count > 1").withColumnRenamed("count", "df")
        self._write(tokens, "common", "all", False)
        self._append(history, self._ordered(sets, self._common()))

    def _common(self) -> DataFrame:
        return self.spark.read.schema("coll string, tok bigint, df bigint, part int").parquet(f"{self.path}/common/gen=all")

    def _folders(self, table: DataFrame, found: list[int]) -> DataFrame:
        """The table's folders of some numbers."""
        return table if len(found) == self.parts else table.filter(F.col("part").isin(found))

    @staticmethod
    def _ordered(sets: DataFrame, common: DataFrame) -> DataFrame:
        """Token arrays put into the fixed order, rarest first."""
        t = sets.select("coll", "sid", "acc", F.explode("toks").alias("tok")).join(common.select("coll", "tok", "df"), ["coll", "tok"], "left")
        ordered = t.groupBy("coll", "sid", "acc").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("a"))
        return ordered.select("coll", "sid", "acc", F.col("a.tok").alias("toks"))

    def _posts(self, sets: DataFrame) -> DataFrame:
        """Prefix postings: a set sharing the required part of its tokens with
        another has one of the other's prefix tokens in its own prefix."""
        n = F.size("toks")
        prefix = n - F.ceil(n * self.share).cast("int") + 1
        return sets.select("coll", "sid", n.alias("n"), F.posexplode(F.slice("toks", 1, prefix)).alias("pos", "tok"))

    def _append(self, accepted: DataFrame, sets: DataFrame, small: bool = False) -> None:
        """Write a generation and mark it as done."""
        generation = f"{len(self.done):06}_{self.share}_{self.parts}"
        files = accepted.filter("fh is not null").groupBy("coll", "fh").agg(F.min("at").alias("acc"))
        for table, name in ((files, "files"), (sets, "sets"), (self._posts(sets), "posts")):
            self._write(table, name, generation, small)
        p, fs = _hadoop(self.spark, f"{self.path}/done/{generation}")
        fs.create(p, True).close()
        self.done.append(generation)

    def _near(self, mine: DataFrame, mine_posts: DataFrame, theirs: DataFrame, their_posts: DataFrame) -> DataFrame:
        """``(coll, sid, own, other, acc, share)`` of sets alike, ``own`` and ``acc``
        from theirs. Only ``mine`` and what it meets moves."""
        a, b = mine_posts.alias("a"), their_posts.alias("b")
        need = F.ceil(self.share / (1 + self.share) * (F.col("a.n") + F.col("b.n")) - 1e-9)
        rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        same = (F.col("a.coll") == F.col("b.coll")) & (F.col("a.tok") == F.col("b.tok"))
        # One common token is enough only for the smallest sets; all others need
        # another token after it, so a common last token never brings them together.
        ahead = (F.col("a.pos") < F.col("a.n") - 1) & (F.col("b.pos") < F.col("b.n") - 1) & (F.col("b.n") >= F.col("a.n") * self.share) & (F.col("b.n") * self.share <= F.col("a.n")) & (rest >= need)
        tiny = int((1 + self.share) / self.share + 1e-9)
        single = ((F.col("a.n") == 1) & (F.col("b.n") <= tiny - 1)) | ((F.col("b.n") == 1) & (F.col("a.n") <= tiny - 1))
        pair = materialize(b.join(a, same & (ahead | single)).select("a.coll", "a.sid", "b.own", F.col("b.sid").alias("other")).distinct(), "pairs")
        p = theirs.select("coll", F.col("sid").alias("other"), "own", "acc", F.col("toks").alias("y")).join(bounded(pair), ["coll", "other", "own"])
        p = p.join(mine.select("coll", "sid", F.col("toks").alias("x")), ["coll", "sid"])
        both = F.size(F.array_intersect("x", "y"))
        p = p.withColumn("share", both / (F.size("x") + F.size("y") - both))
        return p.filter(F.col("share") >= self.share).select("coll", "sid", "own", "other", "acc", "share")

    def step(self, batch: DataFrame) -> DataFrame:
        """``(match_id, entry_id, how)`` of the batch's cases; the rest is accepted."""
        files, sets = self._table("files", f"coll string, fh string, {_ACC}"), self._table("sets", f"coll string, sid bigint, {_ACC}, toks array<bigint>")
        posts = self._table("posts", "coll string, sid bigint, n int, pos int, tok bigint, part int")
        # All that the step joins with the history is made of the batch, and no larger than its tokens and hashes.
        part_bit = f"shiftleft(1L, cast(pmod(xxhash64(coll, t), {self.parts}) as int))"
        size, bits = batch.agg(F.coalesce(F.sum(F.lit(120) + F.coalesce(F.size("toks"), F.lit(0)) * 60), F.lit(0)), F.expr(f"coalesce(bit_or(aggregate(toks, 0L, (s, t) -> s | {part_bit})), 0L)")).first()
        found = [k for k in range(self.parts) if bits >> k & 1]
        small = size <= BROADCAST_BYTES
        few = F.broadcast if small else lambda df: df
        # What is made of a small batch alone is worked on in one task, without a shuffle.
        one = (lambda df: df.coalesce(1)) if small else (lambda df: df)
        batch = one(batch)
        own_sets = batch.filter("sid is not null").groupBy("coll", "sid").agg(F.first("toks").alias("toks"), F.min("at").alias("acc"))
        own_toks = own_sets.select("coll", F.explode("toks").alias("tok")).distinct()
        common = self._folders(self._common(), found).join(few(own_toks), ["coll", "tok"], "left_semi")
        mine = one(materialize(self._ordered(own_sets, few(common)), "mine"))
        mine_posts = self._posts(mine)

        hashes = few(batch.filter("fh is not null").select("coll", "fh").distinct())
        known = files.join(hashes, ["coll", "fh"], "left_semi").groupBy("coll", "fh").agg(F.min("acc").alias("acc"))
        cols = ["coll", "sid", "n", "pos", "tok", "own"]
        posted, every = self._folders(posts, found).withColumn("own", F.lit(False)).select(*cols), sets.withColumn("own", F.lit(False))
        if small:
            return self._at_once(batch, mine, mine_posts, known, every, posted)
        known = materialize(known, "hits")
        # The batch's sets against the history and against each other: of the former only the best is kept.
        posted = posted.unionByName(mine_posts.withColumn("own", F.lit(True)).select(*cols))
        every = every.unionByName(mine.withColumn("own", F.lit(True)))
        near = self._near(mine, mine_posts, every, posted)
        near = materialize(near.groupBy("coll", "sid", "own", F.when(F.col("own"), F.col("other")).alias("other")).agg(F.min(F.struct((-F.col("share")).alias("s"), "acc")).alias("x")).select("coll", "sid", "own", "other", (-F.col("x.s")).alias("share"), "x.acc"), "near")
        old = near.filter("not own").select("coll", "sid", "share", "acc")
        links = near.filter("own and sid <> other").select("coll", "sid", "other", "share").union(mine.select("coll", "sid", F.col("sid").alias("other"), F.lit(1.0).alias("share")))
        # Entries alike in file and chunks stand or fall with the first of them.
        rep = batch.groupBy("coll", F.coalesce("fh", F.concat(F.lit("-"), F.col("entry_id").cast("string"))).alias("f"), "sid").agg(F.min("at").alias("at"), F.first("fh").alias("fh"))
        gone = rep.join(known.select("coll", "fh", F.lit(1).alias("e")), ["coll", "fh"], "left").join(old.select("coll", "sid", F.lit(1).alias("o")), ["coll", "sid"], "left")
        state = gone.select("coll", "f", "sid", "fh", "at", F.when(F.col("e").isNotNull() | F.col("o").isNotNull(), F.lit("case")).otherwise(F.lit("open")).alias("s"))
        while True:
            state = materialize(self._round(state, links), "state")
            if state.filter("s = 'open'").isEmpty():
                break
        taken = state.filter("s = 'accepted'").select(F.col("at.entry_id").alias("entry_id"))
        accepted = batch.join(taken, "entry_id", "left_semi")
        cases = batch.join(taken, "entry_id", "left_anti")
        own_files = accepted.filter("fh is not null").select("coll", "fh", F.col("at").alias("acc"))
        all_files = known.unionByName(own_files).groupBy("coll", "fh").agg(F.min("acc").alias("file_match"))
        own = accepted.filter("sid is not null").groupBy("coll", "sid").agg(F.min("at").alias("acc"))
        # The best match may be one accepted in this step, also where the history has one.
        new = links.join(own.withColumnRenamed("sid", "other"), ["coll", "other"]).select("coll", "sid", "share", "acc")
        c = cases.join(all_files, ["coll", "fh"], "left")
        near = cases.join(old.unionByName(new), ["coll", "sid"]).filter("acc < at").groupBy("entry_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "acc")).alias("x")).select("entry_id", F.col("x.acc.entry_id").alias("near_match"))
        exact = (F.col("file_match").isNotNull()) & (F.col("file_match") < F.col("at"))
        result = c.join(near, "entry_id", "left").select(F.when(exact, F.col("file_match.entry_id")).otherwise(F.col("near_match")).alias("match_id"), "entry_id", F.when(exact, F.lit("exact")).otherwise(F.lit("near")).alias("how"))
        appended = mine.join(own.select("coll", "sid", F.col("acc").alias("a")), ["coll", "sid"]).select("coll", "sid", F.col("a").alias("acc"), "toks")
        found = materialize(result.filter("match_id is not null"), "cases")
        self._append(accepted, appended)
        return found

    def _at_once(self, batch: DataFrame, mine: DataFrame, mine_posts: DataFrame, known: DataFrame, sets: DataFrame, posts: DataFrame) -> DataFrame:
        """The step of a small batch: what the history has for it, at most one row a
        file hash and a set of the batch, goes into one task that settles it. The
        driver plans as many jobs however the entries hang together."""
        near = self._near(F.broadcast(mine), F.broadcast(mine_posts), sets, posts)
        old = near.groupBy("coll", "sid").agg(F.min(F.struct((-F.col("share")).alias("s"), "acc")).alias("o"))
        x = batch.drop("toks", "at").join(F.broadcast(mine.select("coll", "sid", "toks")), ["coll", "sid"], "left")
        x = x.join(F.broadcast(known.withColumnRenamed("acc", "e")), ["coll", "fh"], "left").join(F.broadcast(old), ["coll", "sid"], "left")
        x = x.select("batch_id", "entry_id", "coll", "fh", "sid", "toks", "e", "o").coalesce(1)
        schema = "batch_id int, entry_id bigint, coll string, fh string, sid bigint, toks array<bigint>, match_id bigint, how string, taken boolean"
        settled = materialize(x.mapInArrow(settler(self.share), schema), "settled").coalesce(1)
        accepted = settled.filter("taken").withColumn("at", F.struct("batch_id", "entry_id"))
        self._append(accepted, accepted.filter("sid is not null").select("coll", "sid", F.col("at").alias("acc"), "toks"), True)
        return settled.filter("match_id is not null").select("match_id", "entry_id", "how")

    @staticmethod
    def _round(state: DataFrame, links: DataFrame) -> DataFrame:
        """Settle every open entry with no open entry before it in its file or
        any set alike; later ones wait for another round."""
        least = lambda s: F.min(F.when(F.col("s") == s, F.col("at")))
        by_file = state.filter("fh is not null").groupBy("coll", "f").agg(least("open").alias("f_open"), least("accepted").alias("f_acc"))
        by_set = state.filter("sid is not null").groupBy("coll", F.col("sid").alias("other")).agg(least("open").alias("o"), least("accepted").alias("a"))
        around = links.join(by_set, ["coll", "other"]).groupBy("coll", "sid").agg(F.min("o").alias("s_open"), F.min("a").alias("s_acc"))
        x = state.join(by_file, ["coll", "f"], "left").join(around, ["coll", "sid"], "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
        s = F.when(F.col("s") != "open", F.col("s")).when(before("f_acc") | before("s_acc"), "case").when(before("f_open") | before("s_open"), "open").otherwise("accepted")
        return x.select("coll", "f", "sid", "fh", "at", s.alias("s"))


def check_batches(registry: DataFrame, share: float = SHARE, one_by_one: bool = True) -> DataFrame:
    """``(match_id, entry_id, how)``: batch 0 builds the index, each later one
    steps into it and is appended.

    Without ``one_by_one`` all waiting batches go in one step, with the same
    result, since a step settles its entries in the order of arrival. Replayed
    rows count once; null file hashes and null or empty chunk hashes match
    nothing; a null collection is one collection; rows without entry_id or
    batch_id are left out; an empty table gives no rows; further columns are
    ignored.
    """
    spark = registry.sparkSession
    e = materialize(entries(registry).withColumn("of", F.col("batch_id")), "entries", by="of")
    index = BatchIndex(spark, share)
    index.build(e.filter("of = 0").drop("of"))
    waiting = [r[0] for r in e.filter("of > 0").select("of").distinct().orderBy("of").collect()]  # numbers of batches
    if not one_by_one and waiting:
        return index.step(e.filter("of > 0").drop("of"))
    found = [index.step(e.filter(F.col("of") == b).drop("of")) for b in waiting]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "match_id bigint, entry_id bigint, how string")


def found_query(spark: SparkSession, base: str) -> DataFrame:
    return check_batches(read_table(spark, base, "doc_registry"))
