"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

A document's payload is stored losslessly as 8-bit samples of a private
elementary stream: PES packets of a fixed number of samples with presentation
time stamps, cut into packets of 188 bytes behind a program association and a
program map table; each PES packet begins with a random-access point and a
clock reference. The reader parses the tables, checks sync bytes, table CRCs
and continuity counters, reassembles the elementary packets of every stream of
every program, and gives back the samples with the time stamps and random-access
points. Lost packets are counted, not fatal; repeated packets are passed over.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, map_texts

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_ID, PRIVATE_STREAM = 188, 0x47, 0, 0xBD, 0x06
#: This writer's choices: program, PIDs, samples in a PES packet, ticks of the 90 kHz clock for a sample.
PROGRAM, PMT_PID, ES_PID, PES_SAMPLES, TICKS = 1, 0x100, 0x101, 16384, 3
PAD = 64


def _crc_table() -> np.ndarray:
    rows = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        rows.append(c)
    return rows


_CRC = _crc_table()


def table_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, table_ext: int, body: bytes) -> bytes:
    size = len(body) + 9
    head = bytes([table_id, 0xB0 | size >> 8, size & 255, table_ext >> 8, table_ext & 255, 0xC1, 0, 0]) + body
    return head + table_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_STREAM]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out, counter = [TABLES], 0
    for start in range(0, len(payload), PES_SAMPLES):
        body = payload[start : start + PES_SAMPLES]
        pts = start * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + body
        # first packet: adaptation field with random access and PCR (8 bytes with its length); stuffing where the rest is short
        clock = (pts << 15 | 0x3F << 9).to_bytes(6, "big")
        first = min(len(pes), PACKET - 12)
        stuff = PACKET - 12 - first
        counts = 1 + -(-(len(pes) - first) // 184)
        packets = np.full((counts, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(counts)) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(bytes([7 + stuff, 0x50]) + clock, np.uint8)
        packets[0, PACKET - first :] = np.frombuffer(pes[:first], np.uint8)
        rest = np.frombuffer(pes, np.uint8, offset=first) if first < len(pes) else np.zeros(0, np.uint8)
        full = len(rest) // 184
        packets[1 : 1 + full, 4:] = rest[: full * 184].reshape(full, 184)
        if tail := len(rest) - full * 184:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - tail
            if tail < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - tail :] = rest[full * 184 :]
        counter += counts
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What the reader finds of one elementary stream."""

    program: int = 0
    pid: int = 0
    kind: int = 0
    payload: bytes = b""
    packets: int = 0  # of the whole file
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers in the file
    discontinuities: int = 0
    damaged: int = 0  # PES packets without a start code or whole header, or shorter than they say
    lost: int = 0  # bytes between packets, or after the last whole one
    bad_tables: int = 0  # tables whose CRC is wrong, of the whole file


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray) -> tuple[list[bytes], int]:
    """The sections that begin in packets of a PID, and how many more have a wrong CRC; one that spans packets is put together."""
    found, bad, held = [], 0, b""
    for p in np.flatnonzero(pids == pid):
        row = packets[p].tobytes()
        at = 4 + (1 + row[4] if row[3] & 0x20 else 0)
        if at >= PACKET or not row[3] & 0x10:
            continue
        if row[1] & 0x40:
            held, at = b"", at + 1 + row[at]
        held += row[at:]
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
            if size < 12 or table_crc(held[:size]):
                bad += 1
            else:
                found.append(held[:size])
            held = held[size:]
    return found, bad


def _tables(packets: np.ndarray, pids: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """(program, PID, stream type) of all elementary streams, by the association and map tables, and the number of damaged tables."""
    maps, streams = {}, {}
    found, bad = _sections(packets, PAT_PID, pids)
    for pat in found:
        for k in range(8, len(pat) - 4, 4):
            if number := int.from_bytes(pat[k : k + 2], "big"):
                maps[number] = int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF
    for number, pid in maps.items():
        found, more = _sections(packets, pid, pids)
        bad += more
        for pmt in found:
            if pmt[0] != 2 or int.from_bytes(pmt[3:5], "big") != number or len(pmt) < 16:
                continue
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            while at + 5 <= len(pmt) - 4:
                streams[number, int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF] = pmt[at]
                at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    return [(number, pid, kind) for (number, pid), kind in streams.items()], bad


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """The whole packets of a file, and the bytes that belong to none: where the sync byte is lost, reading goes on at the next one that another follows a packet later, or that ends the file."""
    data = np.frombuffer(media, np.uint8)
    whole = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    if (whole[:, 0] == SYNC).all():
        return whole, len(data) - whole.size
    sync = data == SYNC
    follows = np.ones(len(data), bool)
    follows[: max(len(data) - PACKET, 0)] = sync[PACKET:]
    sure = np.flatnonzero((sync & follows)[: max(len(data) - PACKET + 1, 0)])
    starts, at = [], 0
    while at + PACKET <= len(data):
        if not sync[at]:
            k = np.searchsorted(sure, at)
            if k == len(sure):
                break
            at = int(sure[k])
        starts.append(at)
        at += PACKET
    packets = data[np.array(starts, np.int64)[:, None] + np.arange(PACKET)] if starts else data[:0].reshape(0, PACKET)
    return packets, len(data) - packets.size


def _stream(packets: np.ndarray, own: np.ndarray, result: Stream) -> Stream:
    """Fill in one stream from its packets."""
    rows = packets[own]
    if not len(own):
        return result
    has_field, has_load = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    counter = rows[:, 3].astype(np.int16) & 15
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    # a packet may be sent twice: same counter, same bytes
    again = np.append(False, (counter[1:] == counter[:-1]) & has_load[1:] & has_load[:-1])
    maybe = np.flatnonzero(again)
    again[maybe] = (rows[maybe] == rows[maybe - 1]).all(1)
    own, rows, has_load, counter, flags, has_field = (x[~again] for x in (own, rows, has_load, counter, flags, has_field))
    broken = (counter[1:] - counter[:-1]) % 16 != has_load[1:]
    result.discontinuities = int((broken & (flags[1:] & 0x80 == 0)).sum())
    begin = np.where(has_field, 5 + rows[:, 4].astype(np.int64), 4)
    begin[~has_load] = PACKET
    begin = np.minimum(begin, PACKET)
    result.random_access = own[flags & 0x40 > 0].tolist()
    # all payload bytes in order, then the PES packets by where their first packets begin
    load = rows[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    offset = np.concatenate(([0], np.cumsum(PACKET - begin)))
    heads = [*offset[:-1][rows[:, 1] & 0x40 > 0].tolist(), len(load)]
    parts = []
    for a, b in zip(heads, heads[1:], strict=False):
        # a header has nine bytes and those it says, a time stamp five of them
        if load[a : a + 3] != b"\0\0\1" or b - a < 9 or a + 9 + load[a + 8] > b or load[a + 7] & 0x80 and load[a + 8] < 5:
            result.damaged += 1
            continue
        size = int.from_bytes(load[a + 4 : a + 6], "big")
        end = a + 6 + size if size else b
        result.damaged += end > b
        if load[a + 7] & 0x80:
            s = load[a + 9 : a + 14]
            result.stamps.append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1)
        parts.append(load[a + 9 + load[a + 8] : min(end, b)])
    result.payload = b"".join(parts)
    return result


def demux(media: bytes) -> list[Stream]:
    """Parse a transport stream: one entry for each elementary stream of each program.

    Damage is counted and passed over, whatever it is: bytes out of step with
    packets, tables with a wrong CRC, cut headers. A file without a readable
    table has no stream.
    """
    packets, lost = _packets(media)
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    tables, bad = _tables(packets, pids)
    return [_stream(packets, np.flatnonzero(pids == pid), Stream(program, pid, kind, packets=len(packets), lost=lost, bad_tables=bad)) for program, pid, kind in tables]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its text as a media column: `n_bytes` and `media`, the transport stream, as binary.

    A null text counts as empty (64 zero bytes of payload); equal texts give
    equal streams; repeated rows give repeated rows; a null id stays null; an
    empty table gives no rows; a text of any length is one stream; further
    columns are not read, and an id named like a column of the result is an
    error.
    """

    def run(texts):
        raw = [t.encode() for t in texts]
        return {"n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]}

    return map_texts(docs, lambda: run, "n_bytes bigint, media binary", id_col, text_col)


STREAMS = "program int, pid int, packets bigint, stamps array<bigint>, random_access array<bigint>, discontinuities bigint, damaged bigint, lost bigint, bad_tables bigint, payload binary"


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """`media` with what the first elementary stream of each transport stream holds, next to all its columns but `media_col` itself.

    Adds program, pid, packets, stamps, random_access, discontinuities, damaged,
    lost, bad_tables, payload, media_bytes and media_sha256; a null stream gives
    nulls, and one without readable tables a null program and payload, next to
    its size and digest: no damage fails the job.
    """
    kept = [c for c in media.columns if c != media_col]
    added = STREAMS + ", media_bytes bigint, media_sha256 string"
    made = T.StructType.fromDDL(added)
    schema = T.StructType([*(media.schema[c] for c in kept), *made])
    source = media.select(*kept, media_col)

    def run(batches):
        for block in blocks(batches, len(kept)):
            rows = []
            for data in block.column(len(kept)).to_pylist():
                if data is None:
                    rows.append((None,) * len(made))
                    continue
                s = next(iter(demux(data)), None)
                found = (None,) * (len(made) - 2) if s is None else (s.program, s.pid, s.packets, s.stamps, s.random_access, s.discontinuities, s.damaged, s.lost, s.bad_tables, s.payload)
                rows.append((*found, len(data), hashlib.sha256(data).hexdigest()))
            columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*block.columns[: len(kept)], *columns], names=[*kept, *made.names])

    return source.mapInArrow(run, schema)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the digests and features of its media column, read back: see `media_column`.

    The random-access points and first and last time stamps stand in `feature`.
    """
    read = read_media(media_column(docs, id_col, text_col))
    parts = {
        "program": F.col("program"), "pid": F.col("pid"), "packets": F.col("packets"), "pes": F.size("stamps"), "first_pts": F.get("stamps", F.lit(0)), "last_pts": F.try_element_at("stamps", F.lit(-1)),
        "random_access": F.array_join(F.col("random_access").cast("array<string>"), ","), "discontinuities": F.col("discontinuities"),
    }
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{name}="), c.cast("string")) for name, c in parts.items()))
    payload = F.col("payload")
    return read.select(
        id_col, "n_bytes", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -PAD, PAD)).alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"),
    )
