"""WARC archives of raw pages: written, read back, and merged into one ordered index of captures.

Archives are text files whose rows are records and whose row separator is the blank line that ends a record, so
Spark's own writer and reader move them to and from any store. Each archive yields a run of captures sorted by
URL key and timestamp. After a shuffle by ranges of (URL key, timestamp, id), each task merges the runs that reach
it with a loser tree, so the parts in order are the histories of all captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasieve.session import cut_lineage, shared_folder

END = "\r\n\r\n"
#: Bytes of payload that one archive should hold.
ARCHIVE = 8 << 20
EPOCH = "2024-01-01 00:00:00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, in lower case: sorts captures of one site together."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    if host.startswith("www."):
        host = host[4:]
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    tail = f":{port}" if port and port != usual else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32_digits(digits):
    """Upper-case base32 of 40 hex digits: 5 of them are 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(digits, at, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """Columns id, url, payload, digest, kind (response or revisit) and refers_to for every page.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is the response. Null
    payloads are empty. A null id sorts before all others (rows that repeat an id repeat its record).
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    # fixed-size minima, so that equal payloads meet in hash maps on the map side
    first = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("id").alias("least_id"), F.max(F.col("id").isNull()).alias("unknown"))
    rows = rows.join(first, "sha", "left")
    first_id = F.when(F.col("unknown"), F.lit(None)).otherwise(F.col("least_id"))
    own = F.col("unknown").isNull() | first_id.eqNullSafe(F.col("id"))
    return rows.select("id", "url", "payload", base32_digits(F.col("sha")).alias("digest"), F.when(own, "response").otherwise("revisit").alias("kind"), F.when(~own, first_id).alias("refers_to"))


def _line(text):
    """A column of texts with white space and control characters escaped, so that each is one header line."""
    shown = text
    for code in [*range(0x21), 0x7F]:
        shown = F.replace(shown, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), shown).otherwise(text)


def _record():
    """Rows of ``records`` as record texts without the closing blank line. A revisit keeps no payload."""
    response = F.col("kind") == "response"
    seconds = F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 31))
    date = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "refers_to")]
    size = F.octet_length("payload").cast("string")
    head = [
        "WARC/1.1\r\nWARC-Type: ", F.col("kind"), "\r\nWARC-Record-ID: <urn:page:", named[0], ">\r\nWARC-Date: ", F.replace(date.cast("string"), F.lit(" "), F.lit("T")),
        "Z\r\nWARC-Target-URI: ", _line(F.col("url")), "\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        F.when(response, "").otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), named[1], F.lit(">"))),
        "\r\nX-Payload-Length: ", size, "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.when(response, size).otherwise("0"),
        END, F.when(response, F.col("payload")).otherwise(""),
    ]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head])


def write_archives(recs: DataFrame, folder: str) -> None:
    """Write ``records`` as archives of about ``ARCHIVE`` bytes into ``folder``.

    Records are put together row by row in the JVM: no batch of pages is ever held.
    """
    # payloads alone are asked for, so this pass needs no search for equal ones and no shuffle
    mean = recs.agg(F.avg(F.octet_length("payload") + 512)).first()[0] or 1
    # the records stay where the search for equal payloads put them; files end after so many of mean size
    shown = recs.select(_record().alias("value")).write.option("lineSep", END).option("compression", "gzip")
    shown.option("maxRecordsPerFile", max(1, int(ARCHIVE / mean))).text(folder)


_HEADERS = re.compile(rb"^([A-Za-z0-9-]+): (.*)$")


def parse(archive: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, block) of each record, by its Content-Length."""
    at = 0
    while at < len(archive):
        if archive[at : at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record at byte {at}")
        top = archive.index(b"\r\n\r\n", at)
        headers = dict(m.groups() for m in (_HEADERS.match(x) for x in archive[at:top].split(b"\r\n")[1:]) if m)
        begin = top + 4
        end = begin + int(headers[b"Content-Length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, headers, archive[begin:end]
        at = end + 4


CAPTURES = "url_key string, timestamp string, page_id bigint, archive string, offset bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, place int"
_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def _number(urn: bytes) -> int | None:
    digits = urn.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives; those of one archive form a run sorted by URL key, timestamp and id.

    The digest and length of a response come from its block, those of a revisit from its headers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                name, out = path.rpartition("/")[2], []
                for at, h, block in parse(gzip.decompress(content.as_py())):
                    kind = h[b"WARC-Type"].decode()
                    told = h[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                    size = int(h[b"X-Payload-Length"])
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if (digest, len(block)) != (told, size):
                            raise ValueError(f"{name}: the payload at byte {at} is damaged")
                    refers = _number(h[b"WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((url_key(h[b"WARC-Target-URI"].decode()), h[b"WARC-Date"].decode(), _number(h[b"WARC-Record-ID"]), name, at, size, told, kind, refers))
                out.sort(key=_order)
                cols = list(zip(*out)) if out else [()] * 9
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 2, pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(np.arange(len(out)), pa.int32())], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of their match, so a step replays one path to the top."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = max(1, len(runs))
        self.losers = [-1] * k
        self.winner = -1
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        node = (i + len(self.losers)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of URL key, timestamp and id: part by part, and inside each part.

    Ranges are cut by all three, so one URL with a third of all captures is spread over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        names = table["archive"].to_pylist()
        keys = [_order(x) for x in zip(table["url_key"].to_pylist(), table["timestamp"].to_pylist(), table["page_id"].to_pylist())]
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        runs = [((keys[i], i) for i in range(a, b)) for a, b in zip(starts[:-1], starts[1:])]
        order = np.fromiter((i for _, i in LoserTree(runs)), np.int64, len(names))
        for at in range(0, len(order), 4096):
            yield from table.take(order[at : at + 4096]).to_batches()

    by = [F.col("url_key"), F.col("timestamp"), F.col("page_id")]
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # inside a part, each archive's captures keep the order of their run
    return captures.repartitionByRange(parts, *by).sortWithinPartitions("archive", "place").mapInArrow(run, CAPTURES)


def capture_histories(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and return the merged index of captures.

    Repeated rows are captures of their own. No pages give no archives and an empty index. Other columns are
    ignored. Dates count seconds from ``EPOCH`` by id, as pages carry none.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages, id_col, url_col, body_col, least), folder)
    return merge_index(cut_lineage(read_archives(spark, folder)))
