"""WARC archives of web pages, written by Spark's text writer and read back by boundary chains.

Writing: a record per page; of pages with equal payloads the one with the least id is the response and
the others are revisits without payload. Reading: tasks look for the record magic in byte ranges and
give each place where a header can be read as a candidate, with the place where its successor must
begin. Candidates of a range are chained there; pointer jumping over the ranges, from the file's start,
finds where the true chain enters each range. Whatever it does not reach is magic inside a payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import scratch, stored

MAGIC = b"WARC/1.0\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Revisits are broadcast to the writer up to this many rows (of about 60 bytes); beyond, pages are shuffled to them.
BROADCAST_ROWS = 100_000


class DamagedArchive(ValueError):
    """A record's payload does not have its digest, or a file's chain of records breaks off."""


def base32_sha1(hex_digest: Column) -> Column:
    """A SHA-1 in hex as upper-case base32."""
    out = []
    for k in range(0, 40, 10):
        bits = F.conv(F.substring(hex_digest, k + 1, 10), 16, 10).cast("long")
        for s in range(35, -1, -5):
            out.append(F.substring(F.lit(_ALPHABET), (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"),
    )


def _revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Ids and digests of pages whose payload another response holds, with that response's id."""
    keys = stored(rows.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "sha1"), "warc-keys")
    twins = keys.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twins = stored(twins, "warc-twins")
    return stored(keys.join(twins, "sha1").filter(F.col("page_id") != F.col("refers_to")).distinct(), "warc-revisits")


def write_archives(pages: DataFrame, least_bytes: int = 0) -> str:
    """Write page_id, url, html as WARC files; returns their folder.

    A null html is an empty payload. Payloads under `least_bytes` are always responses, as are pages
    without an id. Rows that repeat the least id of their payload are all responses. Line breaks in urls
    are percent-encoded.
    """
    rows = _keyed(pages)
    revisits = _revisits(rows, least_bytes)
    few = revisits.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "sha1"], "left")
    again = F.col("refers_to").isNotNull()

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))

    def head(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(F.lit(_HTTP), F.when(again, "").otherwise(F.col("html")))
    length = F.lit(len(_HTTP)) + F.when(again, 0).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(MAGIC.decode()), head("WARC-Type", F.when(again, "revisit").otherwise("response")), head("WARC-Record-ID", urn(F.col("page_id"))),
        head("WARC-Date", "2000-01-01T00:00:00Z"), head("WARC-Target-URI", url), head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha1")))),
        head("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(head("WARC-Profile", _PROFILE), head("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        head("Content-Type", "application/http; msgtype=response"), head("Content-Length", length.cast("string")), F.lit("\r\n"), block,
    )
    folder = scratch(pages.sparkSession, "warc")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "none").text(folder)
    return folder


#: The magic as a line of its own.
_LINE = re.compile(rb"(?<![^\n])" + re.escape(MAGIC))
_LENGTH = re.compile("[0-9]{1,18}")


def _header(data: bytes, at: int, end: int) -> tuple[dict[str, str], int] | None:
    """Fields of the record that begins at a place and whose header's blank line is at `end`, and where its
    block begins; None if it is no header, as without a length of at most 18 ASCII digits."""
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("utf-8", "replace").lower()] = value.strip(b" \t").decode("utf-8", "replace")
    return (fields, end + 4) if _LENGTH.fullmatch(fields.get("content-length", "")) else None


def _headers(path: str, start: int, width: int, size: int) -> Iterator[tuple[int, int]]:
    """(place, successor's place) of all headers that begin in a range of a file.

    A header ends at its first blank line and holds no other magic line, so every byte is read for
    one header only, however often the magic is repeated.
    """
    first, ahead = max(0, start - 1), 1 << 16
    data = files.get(path, first, width + ahead + start - first)
    lines = [m.start() for m in _LINE.finditer(data)]
    i = 0
    while i < len(lines) and (at := lines[i]) + first < start + width:
        following = lines[i + 1] if i + 1 < len(lines) else len(data)
        end = data.find(b"\r\n\r\n", at, following)
        if end < 0 and following == len(data) and first + len(data) < size:
            ahead *= 4  # a header that is longer than what was read ahead
            data = files.get(path, first, width + ahead + start - first)
            lines = [m.start() for m in _LINE.finditer(data)]
            continue
        # What looks like a line at the front of the data may follow another character.
        if end >= 0 and at + first >= start and (at or not first) and (h := _header(data, at, end)):
            yield first + at, first + h[1] + int(h[0]["content-length"]) + 4
        i += 1


_CANDIDATE = "path string, range long, place long, next long, exit long, length long"


def _candidates(ranges: DataFrame, width: int) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, size in zip(frame["path"], frame["range"].tolist(), frame["length"].tolist(), strict=True):
                found = list(_headers(path, start, width, size))
                leaves: dict[int, int] = {}
                for place, following in reversed(found):
                    leaves[place] = leaves.get(following, following)
                yield pd.DataFrame(
                    [(path, start, p, n, leaves[p], size) for p, n in found], columns=["path", "range", "place", "next", "exit", "length"],
                )

    return ranges.mapInPandas(scan, _CANDIDATE)


def _entries(candidates: DataFrame) -> DataFrame:
    """Places (path, place) where the chains from the files' starts enter ranges, by pointer jumping."""
    jump = candidates.select("path", "place", "exit")
    reached = candidates.filter("place = 0").select("path", "place")
    known = -1
    while True:
        reached = stored(reached, "warc-reached")
        n = reached.count()
        if n == known:
            return reached
        known = n
        ahead = reached.join(jump, ["path", "place"]).join(candidates.select("path", F.col("place").alias("exit")), ["path", "exit"], "left_semi")
        reached = reached.unionByName(ahead.select("path", F.col("exit").alias("place"))).distinct()
        further = jump.select("path", F.col("place").alias("exit"), F.col("exit").alias("to"))
        jump = stored(jump.join(further, ["path", "exit"], "left").select("path", "place", F.coalesce("to", "exit").alias("exit")), "warc-jump")


def read_archives(spark: SparkSession, folder: str, width: int = 1 << 24) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are checked against their digests; a revisit's size and digest are those its
    header gives. `width` is the range of bytes that one task holds, besides one record's overhang.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").filter("length > 0")
    n = F.lit(width).cast("long")
    ranges = stored(listing.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, n)).alias("range")), "warc-ranges")
    count = max(1, ranges.count())
    candidates = stored(_candidates(ranges.repartition(count, "path", "range"), width), "warc-candidates")
    entries = _entries(candidates).withColumn("entry", F.lit(True))

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        path, start, size = frame["path"].iloc[0], int(frame["range"].iloc[0]), int(frame["length"].iloc[0])
        nexts = dict(zip(frame["place"].tolist(), frame["next"].tolist(), strict=True))
        true, rows = [], []
        for at in sorted(frame["place"][frame["entry"].notna()].tolist()):
            while at in nexts:
                true.append((at, nexts[at]))
                at = nexts[at]
            if at < start + width and at != size or at > size:
                raise DamagedArchive(f"{path}: no record at {at}")
        data = files.get(path, true[0][0], true[-1][1] - true[0][0]) if true else b""
        for at, end in true:
            fields, body = _header(data, at - true[0][0], data.index(b"\r\n\r\n", at - true[0][0]))
            block = data[body : end - 4 - true[0][0]]
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            size_of = int(fields["x-payload-length"])
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size_of:
                    raise DamagedArchive(f"{path}: the payload of the record at {at} does not have its digest")
            ids = [fields.get(k, "")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to")]
            rows.append((*[None if i in ("", "none") else int(i) for i in ids], size_of, digest, kind))
        out = pd.DataFrame(rows, columns=["page_id", "refers_to", "payload_bytes", "payload_digest", "record_type"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]]

    marked = candidates.join(entries, ["path", "place"], "left")
    return marked.groupBy("path", "range").applyInPandas(follow, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
