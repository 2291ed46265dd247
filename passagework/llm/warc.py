"""WARC archives and their fixity audit by Merkle trees.

Pages become records of WARC 1.1 files, ordered within their archive. The hash of a record
is a leaf; a node hashes the offsets and the hashes of ``FANOUT`` neighbours, up to the
archive, and on over ordered ranges of archives to one root. Two replicas whose roots are
equal are equal. Where they differ, the audit compares only the children of nodes that
differ, level by level, down to the records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from passagework.llm.common import save, sent_if_small
from passagework.sources.tables import work_dir

ARCHIVE_BYTES = 16 << 20
FILE_BYTES = 32 << 20
FANOUT = 16
_END = "\r\n\r\n"


def _line(value: Column) -> Column:
    """A header value: line breaks would end it and are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _ranged(pages: DataFrame, id: str, url: str, html: str, archive_bytes: int) -> DataFrame:
    """(archive, _range, _n, _at, long, _id, record, digest), saved: the records in ranges of their order.

    ``_n`` and ``_at`` are a record's number and byte offset among those of its archive in
    its range; ``_range`` numbers the ranges in the order of archive, id, address and content.
    """
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:"), _line(name),
        F.lit(">\r\nWARC-Target-URI: "), _line(F.col(url)),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END),
    )
    made = pages.select(
        F.col(id).alias("_id"), name.alias("_name"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.concat(head, body).alias("record"),
    ).withColumn("long", F.octet_length("record").cast("long")).withColumn("_key", F.xxhash64("_name", "_url"))
    sums = save(made.select("_key", "long", F.xxhash64("record").alias("h")).groupBy("_key").agg(
        F.sum("long").alias("bytes"), (F.min("h") != F.max("h")).alias("_differ")
    ), "sums")
    size = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    archives = max(1, -(-int(size) // archive_bytes))
    place = F.conv(F.substring(F.md5(F.concat("_name", F.lit(" "), "_url")), 1, 8), 16, 10).cast("long") % archives
    # Only where one id and address have much text do ranges part their records: by content if it differs, copies anyhow.
    heavy = sent_if_small(save(sums.where(F.col("bytes") > archive_bytes // 4).select("_key", "_differ"), "heavy"))
    marked = made.withColumn("archive", place).join(heavy, "_key", "left")
    dealt = marked.withColumns({
        "_text": F.when(F.col("_differ"), F.col("record")),
        "_salt": F.when(F.col("_differ").isNotNull(), F.monotonically_increasing_id()),
    }).repartitionByRange(
        max(archives, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive", "_id", "_url", "_text", "_salt"
    )
    ordered = dealt.select("archive", "long", "_id", "_url", "record").sortWithinPartitions("archive", "_id", "_url", "record").select(
        F.spark_partition_id().cast("long").alias("_range"), "archive", "long", "_id", "record"
    )
    kind = StructType([StructField("_n", LongType()), StructField("_at", LongType()), *ordered.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = None, 0, 0
        for batch in batches:
            numbers, starts = [], []
            for archive, long in zip(batch.column("archive").to_pylist(), batch.column("long").to_pylist()):
                if archive != now:
                    now, n, at = archive, 0, 0
                numbers.append(n)
                starts.append(at)
                n, at = n + 1, at + long + len(_END)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), *batch.columns], names=["_n", "_at", *batch.schema.names]
            )

    return save(ordered.mapInArrow(run, kind).withColumn("digest", F.sha2(F.encode("record", "UTF-8"), 256)), "ranged")


def _numbered(ranged: DataFrame) -> DataFrame:
    """Saved ranges with ``ordinal`` and ``start``, from a small table of what earlier ranges of an archive hold."""
    earlier = Window.partitionBy("archive").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    held = ranged.groupBy("archive", "_range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("long") + len(_END)).alias("bytes"))
    first = sent_if_small(save(held.select("archive", "_range", before("n").alias("_first"), before("bytes").alias("_from")), "offsets"))
    return ranged.join(first, ["archive", "_range"]).withColumns({
        "ordinal": (F.col("_first") + F.col("_n")).cast("long"), "start": (F.col("_from") + F.col("_at")).cast("long"),
    }).drop("_range", "_n", "_at", "_first", "_from")


def records(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """(archive, ordinal, start, long, _id, record): the pages as records in their archives.

    A page's archive follows from a hash of its id and address, the number of archives from
    the bytes of all pages. Records are ordered by id, address and content; ``start`` is
    the byte offset in the uncompressed archive, ``long`` the record's bytes. An archive is
    numbered in ranges of this order, so no task holds one whole, however many pages share
    an id and address. Where these have different contents, the sampled bounds of ranges
    hold contents, too.

    Null addresses and contents are written as empty ones, a null id as the empty name.
    Repeated rows are repeated records; an empty table has no archives; other columns are
    not looked at.
    """
    return _numbered(_ranged(pages, id, url, html, archive_bytes).drop("digest")).select(
        "archive", "ordinal", "start", "long", "_id", "record"
    )


def write_archives(found: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Compressed WARC files under ``folder/archive=<number>_<piece>_<ordinal>_<start>``.

    An archive of more than ``file_bytes`` is cut into pieces of at most so many bytes and
    one record; the folder names a piece's first ordinal and offset, so each is read by itself.
    """
    cut = found.select("archive", "ordinal", "start", "record").withColumn("_piece", F.floor(F.col("start") / file_bytes).cast("long"))
    first = sent_if_small(save(
        cut.groupBy("archive", "_piece").agg(F.min("ordinal").alias("_first"), F.min("start").alias("_from")), "pieces"
    ))
    named = F.concat_ws("_", "archive", "_piece", "_first", "_from")
    cut.join(first, ["archive", "_piece"]).select(named.alias("archive"), "ordinal", "record").repartition(
        "archive"
    ).sortWithinPartitions("archive", "ordinal").select("archive", "record").write.partitionBy("archive").option(
        "lineSep", _END
    ).option("compression", "gzip").text(folder)


def unpacked(content: bytes, step: int = 4096) -> bytes:
    """What a gzip file holds; of a damaged one, what can be read before the damage."""
    out, reader = [], zlib.decompressobj(31)
    try:
        for i in range(0, len(content), step):
            out.append(reader.decompress(content[i:i + step]))
    except zlib.error:
        pass
    return b"".join(out)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, ordinal, start, long, digest) of the records in stored archives.

    A record ends where its length says. What can't be read as a record, to the end of the
    file (a piece of its archive), is one last record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    length = re.compile(rb"\r\nContent-Length: *([0-9]+)\r\n", re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, content in zip(batch.column("archive"), batch.column("content")):
                data, at = unpacked(content.as_py()), 0
                number, _, ordinal, start = map(int, archive.as_py().split("_"))
                while at < len(data):
                    head = data.find(b"\r\n\r\n", at)
                    known = length.search(data, at, head + 2) if head >= 0 and data.startswith(b"WARC/", at) else None
                    end = head + 4 + int(known[1]) if known else len(data)
                    if data[end:end + 4] != b"\r\n\r\n":
                        end = len(data)
                    rows.append((number, ordinal, start + at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at, ordinal = end + 4, ordinal + 1
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["archive", "ordinal", "start", "long", "digest"]
            )

    one = files.select(F.col("archive").cast("string").alias("archive"), "content")
    return one.mapInArrow(run, "archive long, ordinal long, start long, long long, digest string")


def leaves(found: DataFrame) -> DataFrame:
    """(archive, ordinal, start, long, digest) of records held as text."""
    return found.select("archive", "ordinal", "start", "long", F.sha2(F.encode("record", "UTF-8"), 256).alias("digest"))


def tree(found: DataFrame, fanout: int = FANOUT, floors: tuple[int, int] | None = None) -> list[DataFrame]:
    """The levels of the Merkle tree over saved leaves, leaves first, root last.

    Every level has (archive, place, digest). Archives are joined as ranges of archive
    numbers above their own roots. ``floors`` are the levels within an archive and above,
    when another replica's tree has to be as high.
    """
    inner, outer = floors or heights(found, fanout)
    levels = [found.select("archive", F.col("ordinal").alias("place"), F.concat_ws(":", "start", "long", "digest").alias("digest"))]
    for floor in range(inner + outer):
        below = levels[-1].withColumn("child", F.col("place") if floor < inner else F.col("archive"))
        key = ["archive", "place"] if floor < inner else ["archive"]
        up = below.withColumn("place", F.floor(F.col("place") / fanout).cast("long")) if floor < inner else below.withColumn(
            "archive", F.floor(F.col("archive") / fanout).cast("long")
        )
        grouped = up.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("child", "digest"))).alias("children"))
        digest = F.sha2(F.to_json(F.struct("children")), 256)
        levels.append(save(grouped.select(
            "archive", F.col("place") if floor < inner else F.lit(0).cast("long").alias("place"), digest.alias("digest")
        ), f"level{floor + 1}"))
    return levels


def heights(found: DataFrame, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels that a tree needs within archives and above them."""
    most, last = found.agg(F.coalesce(F.max("ordinal"), F.lit(0)), F.coalesce(F.max("archive"), F.lit(0))).first()

    def floors(n: int) -> int:
        k = 0
        while fanout**k <= n:
            k += 1
        return k

    return floors(most), floors(last)


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, ordinal, fault): the records in which replica ``two`` differs from ``one``.

    Both are saved leaves. The fault is ``changed``, ``missing`` or ``extra``.
    """
    a, b = heights(one, fanout), heights(two, fanout)
    inner, outer = max(a[0], b[0]), max(a[1], b[1])
    left, right = tree(one, fanout, (inner, outer)), tree(two, fanout, (inner, outer))
    wrong = None
    for floor in range(inner + outer, -1, -1):
        # A node's parent: within an archive by place, above by archive.
        parent = (
            [F.col("archive").alias("_a"), F.floor(F.col("place") / fanout).cast("long").alias("_p")] if floor < inner
            else [F.floor(F.col("archive") / fanout).cast("long").alias("_a"), F.lit(0).cast("long").alias("_p")]
        )
        sides = []
        for level, name in ((left[floor], "x"), (right[floor], "y")):
            side = level.select("archive", "place", F.col("digest").alias(name), *parent)
            if wrong is not None:
                side = side.join(wrong.select(F.col("archive").alias("_a"), F.col("place").alias("_p")), ["_a", "_p"], "left_semi")
            sides.append(side.select("archive", "place", name))
        wrong = save(sides[0].join(sides[1], ["archive", "place"], "full").where("not (x <=> y)"), "differing")
    return wrong.select(
        "archive", F.col("place").alias("ordinal"),
        F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed").alias("fault"),
    )


def audited(
    pages: DataFrame, damage: Column, id: str = "page_id", url: str = "url", html: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, fanout: int = FANOUT,
) -> DataFrame:
    """Store a replica whose contents went through ``damage``, audit it against the pages' own tree.

    One row per page: (_id, archive, ordinal, start, long, digest, fault); ``fault`` is
    null for records that are as they should be.
    """
    spark = pages.sparkSession
    ranged = _ranged(pages.select(id, url, html), id, url, html, archive_bytes)
    listed = save(_numbered(ranged.drop("record")).select("_id", "archive", "ordinal", "start", "long", "digest"), "leaves")
    own = _numbered(ranged.drop("digest"))
    stored = f"{work_dir(spark, 'replica')}"
    # The damage comes after the lengths were written, as it does to stored files.
    cut = F.length("record") - F.length(F.col("body"))
    spoiled = own.withColumn("body", F.substring_index("record", _END, -1)).withColumn(
        "record", F.concat(F.substring("record", F.lit(1), cut), damage)
    ).drop("body")
    write_archives(spoiled, stored)
    faults = audit(listed, save(read_archives(spark, stored), "stored_leaves"), fanout)
    return listed.join(faults.where("fault != 'extra'"), ["archive", "ordinal"], "left").select(
        "_id", "archive", "ordinal", "start", "long", "digest", "fault"
    )
