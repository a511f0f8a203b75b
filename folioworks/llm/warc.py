"""A content-addressed web archive.

Every distinct payload is stored once, under its SHA-256. The exact header bytes of every record are stored apart, with the
digest they point to. Records are rebuilt by joining the two, written as WARC files, and read back from those files.

Digests are verified: all payloads of one digest must agree in length, SHA-1 and CRC-32 when they are stored, and a record
whose bytes do not give the digests in its header fails when it is read.

Records of payloads from REVISIT_FROM bytes on: the one with the largest page_id is a response, the others revisit it; a null
page_id counts as smaller than any. Among repeated rows of that page one is the response, the rest refer to its page_id.
Smaller payloads are always responses. A null html is an empty payload; a null url becomes a name made of the page_id.
Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one file, so that a reader holds a file at a time.
RECORDS_A_FILE = 2000
END = "\r\n\r\n"

READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(c: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def index(pages: DataFrame) -> DataFrame:
    """One slim row per page, without its payload: row, page_id, url, n, sha1, crc and the digest."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.octet_length(body).cast("long").alias("n"), F.sha1(body).alias("sha1"), F.crc32(body).alias("crc"), F.sha2(body, 256).alias("digest"))
    return common.written(slim, "warc-index")


def elect(slim: DataFrame) -> DataFrame:
    """The index with record_type and refers_to. Groups are formed by partial maxima, and hot payloads are never put in one task."""
    first = F.struct(F.col("page_id").isNotNull().alias("given"), "page_id", F.negative(F.col("row")).alias("turn"))
    groups = slim.groupBy("digest").agg(
        F.count("*").alias("n_pages"), F.max(first).alias("_first"),
        ((F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1")) & (F.min("crc") == F.max("crc"))).alias("_same"),
    )
    groups = groups.withColumn("n_pages", F.when(F.col("_same"), F.col("n_pages")).otherwise(F.raise_error(F.lit("different payloads of one digest")).cast("bigint")))
    groups = common.written(groups.select("digest", "n_pages", F.negative(F.col("_first.turn")).alias("_row"), F.col("_first.page_id").alias("_page")), "warc-groups")
    revisit = (F.col("n") >= REVISIT_FROM) & (F.col("row") != F.col("_row"))
    out = common.hot_join(slim, groups, "digest", "n_pages")
    return out.select(
        *slim.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_page")).alias("refers_to"),
        (revisit & F.col("_page").isNull()).alias("refers_to_none"),
    )


def headers(elected: DataFrame, date: str) -> DataFrame:
    """The exact header bytes of every record, as text: the WARC header, and the HTTP head that opens its block."""
    http = F.concat(_lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n").cast("string"))), F.lit(END))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), http)
    is_revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("n"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), _page(F.col("page_id")))
    warc = _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), _page(F.col("page_id")), F.lit(":"), F.col("row").cast("string"), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Payload-SHA256", F.col("digest")),
        ("WARC-Refers-To", F.when(is_revisit, F.concat(F.lit("<"), _page(F.col("refers_to")), F.lit(">")))),
        ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    return elected.select("digest", "record_type", "n", F.concat(F.lit("WARC/1.1\r\n"), warc, F.lit(END), http).alias("head"))


def payload_store(pages: DataFrame) -> DataFrame:
    """(digest, n, body): every distinct payload once, with its length. Copies meet in partial aggregates before anything is shuffled."""
    body = F.coalesce("html", F.lit(""))
    return common.written(pages.select(F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), body.alias("body")).groupBy("digest").agg(F.first("body").alias("body")).select("digest", F.octet_length("body").cast("long").alias("n"), "body"), "warc-payloads")


def rebuild(heads: DataFrame, store: DataFrame) -> DataFrame:
    """(record): the original record of every header: a revisit is its header, a response takes its payload from the store.

    A digest of a large payload has one response; one of a small payload may have any number, so that join heeds hot digests.
    """
    is_large = F.col("n") >= REVISIT_FROM
    responses = heads.where("record_type = 'response'").select("digest", "n", "head")
    large = responses.where(is_large).join(store.where(is_large).select("digest", "body"), "digest")
    few = responses.where(~is_large).drop("n")
    counts = few.groupBy("digest").agg(F.count("*").alias("share"))
    small = common.hot_join(few, store.where(~is_large).select("digest", "body").join(counts, "digest"), "digest", "share")
    made = [x.select(F.concat("head", "body").alias("record")) for x in (large, small)]
    return made[0].unionByName(made[1]).unionByName(heads.where("record_type = 'revisit'").select(F.col("head").alias("record")))


def write_files(records: DataFrame, path: str) -> None:
    """WARC files, compressed whole. A record ends with two line ends, which is what the writer puts after each row."""
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _number(name: str) -> int | None:
    value = name.strip("<>").split(":")[2]
    return None if value == "none" else int(value)


def parse(data: bytes):
    """Every record of a WARC file as a row of READ; raises when lengths or digests do not hold."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        block = stop + 4
        end = block + int(head["Content-Length"])
        http = data.index(b"\r\n\r\n", block) + 4
        n = int(next(x.split(b": ")[1] for x in data[block:http].split(b"\r\n") if x.startswith(b"Content-Length")))
        payload, digest, revisit = data[http:end], head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest or hashlib.sha256(payload).hexdigest() != head["WARC-Payload-SHA256"]):
            raise ValueError(f"the record at byte {at} has another digest")
        yield _number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], _number(head["WARC-Refers-To"]) if revisit else None, n, digest, None if revisit else payload
        at = end + 4


def read_files(spark, path: str, payload: bool = True) -> DataFrame:
    """READ of all records in a folder of WARC files, through Spark's own file reader; payloads are null unless asked for."""
    schema = READ if payload else READ.replace(", payload binary", "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    width = len(names) if payload else len(names) - 1

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_buffer().to_pybytes()
                rows = list(parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + 500]], kinds[i]) for i in range(width)], names=names[:width])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> str:
    """Store, rebuild and write all pages; the folder of the WARC files."""
    heads = common.written(headers(elect(index(pages)), date), "warc-headers")
    path = common.new_path(pages.sparkSession, "warc-files")
    write_files(rebuild(heads, payload_store(pages)), path)
    return path


ship_by_value(__name__)
