"""Messages delivered more than once (problem 3).

Every row claims one message identity: rows with a revision the identity
(did, rev, collection, rkey), rows without one the weaker identity
(did, cid, collection, rkey), on which rows with a revision leave a mark.

Per batch of arrivals:

1. arrivals are reduced to one row per distinct identity with its first arrival
   (partial aggregation first, so a message that makes up a third of all rows
   costs one row per map task);
2. identities are encoded by an exact dictionary: those it lacks get the next
   free integer and are appended to it;
3. seen-bitmaps, cut into buckets of 32,768 bits by the integer and written
   compressed, tell which integers were accepted or marked before; one arrival
   is selected for each integer whose bit is unset;
4. the new bits are united with the old ones and the next version is committed
   by creating one file. Until then nothing of the batch counts: after a crash
   the dictionary's surplus entries are unread and the batch is simply run again.

The rows themselves are never shuffled by identity: redundant rows are all
arrival numbers minus the selected ones, an anti join on a unique integer.

Defined results for odd input: null parts of an identity are equal to each
other; an arrival number must be unique and not null; of arrivals in one batch
the smallest number is selected; a copy accepted in an earlier batch stays, but
an accepted row without revision becomes redundant when a row with a revision
of the same content arrives later (it is then returned by that batch); an empty
batch commits a version without new bits; other columns are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_path, hadoop_fs

GROUPS = 4  # runs of arrivals in which a whole table is taken in
TASK_BITS, ROW_BITS = 30, 33  # of a code
IDENTITY = ("strong", "did", "mark", "collection", "rkey")


#: What the store writes; told to every reader, so that none has to look into the files for it.
WRITTEN = {
    "dictionary": "strong boolean, did string, mark string, collection string, rkey string, first bigint, is_marked boolean, code bigint, is_new boolean",
    "accepted": "code bigint, seq bigint",
    "accepted-all": "code bigint, seq bigint",
    "overtaken": "seq bigint",
    "bitmaps": "bucket bigint, seen binary, marked binary",
}


def claims(rows: DataFrame) -> DataFrame:
    """(identity..., seq, own): own is null-free and false where the row only leaves a mark."""
    strong = F.col("rev").isNotNull()

    def claim(is_strong: Column | bool, mark: Column, own: Column | bool) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_column(is_strong).alias("strong"), mark.alias("mark"), as_column(own).alias("own"))

    weak = claim(False, F.col("cid"), ~strong)
    both = F.when(strong, F.array(claim(True, F.col("rev"), True), weak)).otherwise(F.array(weak))
    return rows.select("seq", "did", "collection", "rkey", F.explode(both).alias("claim")).select(
        "seq", "claim.strong", "did", "claim.mark", "collection", "rkey", "claim.own"
    )


def _bit_is_set(bitmap: Column, code: Column) -> Column:
    place = F.bitmap_bit_position(code)
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class SeenStore:
    """Dictionary and seen-bitmaps in a folder that all executors share.

    A code is the number of the task that wrote it, counted over all batches (30
    bits), and the row in the task (33 bits): dense inside a task, so its bits
    fill whole buckets, and unique without a counter that tasks share. Each part of
    the dictionary leaves the number at which the next one goes on. The written
    dictionary is the only source of codes, hence a task that runs again cannot
    give two codes to an identity. ``seen`` bits say that an identity was accepted
    or marked, ``marked`` bits that a row with a revision marked it. ``compact``
    makes one part of all parts of the dictionary and of the accepted rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or fresh_path(spark, "seen")).rstrip("/")

    def _numbers(self, what: str) -> list[int]:
        """Numbers of the files or folders of a kind."""
        fs, folder = hadoop_fs(self.spark, f"{self.path}/{what}")
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder))

    def _mark(self, what: str, number: int) -> bool:
        """Creates an empty file, which either happens or does not; false where there is one."""
        fs, file = hadoop_fs(self.spark, f"{self.path}/{what}/{number}")
        return fs.createNewFile(file)

    def version(self) -> int:
        """The last committed version, 0 for an empty store."""
        return max(self._numbers("commits"), default=0)

    def _read(self, what: str, numbers: list[int]) -> DataFrame | None:
        return self.spark.read.schema(WRITTEN[what]).parquet(*(f"{self.path}/{what}/{n}" for n in numbers)) if numbers else None

    def _dictionary_parts(self) -> list[int]:
        """Complete parts of the dictionary, from the last one that holds all before it."""
        whole = max(self._numbers("dictionary-whole"), default=0)
        return [n for n in self._numbers("dictionary-next") if n >= whole]

    def _accepted_before(self, version: int) -> DataFrame:
        """(code, seq) of all rows accepted up to a version."""
        whole = max((n for n in self._numbers("accepted-whole") if n <= version), default=0)
        later = self._read("accepted", list(range(whole + 1, version + 1)))
        if not whole:
            return later
        base = self._read("accepted-all", [whole])
        return base if later is None else base.unionByName(later)

    def _next_task(self) -> int:
        """The number of the first task of the next part of the dictionary."""
        done = self._numbers("dictionary-next")
        return max((max(self._numbers(f"dictionary-next/{n}"), default=0) for n in done), default=0)

    def _finish(self, part: int, next_task: int) -> None:
        """Makes a part of the dictionary count."""
        fs, folder = hadoop_fs(self.spark, f"{self.path}/dictionary-next/{part}")
        fs.mkdirs(folder)
        self._mark(f"dictionary-next/{part}", next_task)

    def dictionary(self) -> DataFrame | None:
        """(identity..., code), parts of batches that failed later included."""
        parts = self._read("dictionary", self._dictionary_parts())
        return parts.where("is_new").select(*IDENTITY, "code") if parts is not None else None

    def bitmaps(self) -> DataFrame | None:
        """(bucket, seen, marked): two bitmaps of 32,768 bits for each bucket of codes."""
        now = self.version()
        return self._read("bitmaps", [now]) if now else None

    def _write(self, df: DataFrame, what: str, number: int) -> DataFrame:
        path = f"{self.path}/{what}/{number}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self._read(what, [number])

    def _encode(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """One row per distinct identity of the batch: first own arrival, marked, code; and the part of the dictionary they are."""
        arrivals = claims(rows).groupBy(*IDENTITY).agg(
            F.min(F.when(F.col("own"), F.col("seq"))).alias("first"), F.max(~F.col("own")).alias("is_marked")
        )
        part = max(self._numbers("dictionary"), default=0) + 1
        fresh = F.shiftleft(F.lit(self._next_task()).cast("bigint"), ROW_BITS) + F.monotonically_increasing_id()
        known = self.dictionary()
        if known is None:
            encoded = arrivals.withColumn("code", fresh).withColumn("is_new", F.lit(True))
        else:
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in IDENTITY]
            met = arrivals.alias("a").join(known.alias("k"), same, "left")
            encoded = (
                met.select(*(F.col(f"a.{c}") for c in IDENTITY), "first", "is_marked", "code")
                .withColumn("is_new", F.col("code").isNull())
                .withColumn("code", F.coalesce("code", fresh))
            )
        return self._write(encoded, "dictionary", part), part

    def _close(self, written: DataFrame, part: int) -> None:
        """Makes a written part of the dictionary count, if its codes are in bounds."""
        last, least = written.where("is_new").agg(F.max(F.shiftright("code", ROW_BITS)), F.min("code")).first()
        if last is not None and (last >= 1 << TASK_BITS or least < 0):
            raise OverflowError(f"{self.path} has given out the codes of 2^{TASK_BITS} tasks")
        self._finish(part, self._next_task() if last is None else last + 1)

    def accept(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Take one batch in; returns (seq) of the rows that are redundant from now on.

        ``batch`` (from 0, as streaming counts) makes a repeated call harmless: a
        batch whose version is committed only has its result read again.
        """
        now = self.version()
        if batch is not None and batch < now:
            return self._result(rows, batch + 1)
        written, part = self._encode(rows)
        encoded = written.select("code", "first", "is_marked", "is_new")
        bucket = F.bitmap_bucket_number("code").alias("bucket")
        old = self.bitmaps()
        if old is None:
            probed = encoded.withColumn("was_seen", F.lit(False)).withColumn("was_marked", F.lit(False))
        else:
            # only codes from earlier parts of the dictionary can have bits
            met = encoded.where(~F.col("is_new")).withColumn("bucket", bucket).join(old, "bucket", "left")
            for bits in ("seen", "marked"):
                met = met.withColumn(f"was_{bits}", F.coalesce(_bit_is_set(F.col(bits), F.col("code")), F.lit(False)))
            new = encoded.where("is_new").withColumn("was_seen", F.lit(False)).withColumn("was_marked", F.lit(False))
            probed = met.select(*new.columns).unionByName(new)
        unseen = probed.where(~F.col("was_seen") & ~F.col("is_marked") & F.col("first").isNotNull())
        position = F.bitmap_bit_position("code")
        here = encoded.groupBy(bucket).agg(
            F.bitmap_construct_agg(position).alias("seen"),
            F.bitmap_construct_agg(F.when(F.col("is_marked"), position)).alias("marked"),
        )
        if old is not None:
            here = old.unionByName(here).groupBy("bucket").agg(
                F.bitmap_or_agg("seen").alias("seen"), F.bitmap_or_agg("marked").alias("marked")
            )
        jobs = [
            lambda: self._close(written, part),
            lambda: self._write(unseen.select("code", F.col("first").alias("seq")), "accepted", now + 1),
            lambda: self._write(here, "bitmaps", now + 1),
        ]
        if now:
            late = probed.where("is_marked AND was_seen AND NOT was_marked").select("code")
            overtaken = self._accepted_before(now).join(late, "code", "left_semi").select("seq")
            jobs.append(lambda: self._write(overtaken, "overtaken", now + 1))
        # they read what is written already and not each other; the commit waits for all
        with ThreadPoolExecutor(len(jobs)) as pool:
            for job in [pool.submit(x) for x in jobs]:
                job.result()
        if not self._mark("commits", now + 1):
            raise RuntimeError(f"version {now + 1} of {self.path} was committed by another writer")
        return self._result(rows, now + 1)

    def compact(self) -> None:
        """One part instead of many for the dictionary and the accepted rows; codes, bits and the version stay as they are.

        Call it between batches; readers of older parts may go on.
        """
        now, known = self.version(), self.dictionary()
        if not now or known is None:
            return
        part = max(self._numbers("dictionary")) + 1
        self._write(known.withColumn("is_new", F.lit(True)), "dictionary", part)
        self._finish(part, self._next_task())
        self._mark("dictionary-whole", part)
        self._write(self._accepted_before(now), "accepted-all", now)
        self._mark("accepted-whole", now)

    def kept(self) -> DataFrame:
        """(seq) of all rows accepted so far that no later one has overtaken."""
        now = self.version()
        accepted, overtaken = self._accepted_before(now).select("seq"), self._read("overtaken", list(range(2, now + 1)))
        return accepted if overtaken is None else accepted.join(overtaken, "seq", "left_anti")

    def _result(self, rows: DataFrame, version: int) -> DataFrame:
        """Redundant after a committed version: its batch but for the selected rows, and rows overtaken by it."""
        redundant = rows.select("seq").join(self._read("accepted", [version]).select("seq"), "seq", "left_anti")
        return redundant.unionByName(self._read("overtaken", [version])) if version > 1 else redundant


def redundant_rows(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(seq) of every redundant row of a whole table, taken into a new store in GROUPS runs of arrivals.

    The runs are cut by arrival number, so that of all copies the first stays
    also where batches overlap; from the second on the bits decide.
    """
    store = SeenStore(rows.sparkSession, path)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return store.accept(rows)
    cuts = [low + (high - low + 1) * i // GROUPS for i in range(GROUPS)] + [high + 1]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            store.accept(rows.where(F.col("seq").between(a, b - 1)))
    return rows.select("seq").join(store.kept(), "seq", "left_anti")


def exactly_once(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` without the redundant ones."""
    return rows.join(redundant_rows(rows, path), "seq", "left_anti")
