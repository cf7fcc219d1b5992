"""Media columns as MPEG transport streams (ISO/IEC 13818-1): written, parsed back and described.

`mux` puts a payload into 188-byte packets: a program association table and a program map table with one private-data
stream, sent again before every random-access point, then one elementary packet (PES) per `PES_BYTES` of payload with
a 90 kHz presentation timestamp, whose first packet carries the program clock, `TICKS` behind the timestamp. Every
`RAP_EVERY`-th begins with the random-access flag set. `demux` reads any stream: it finds the program maps through the
association table, joins tables over packets and checks their CRCs, checks each PID's continuity counters, and
reassembles the elementary packets of every PID into payload, timestamps and random-access points.

Defined cases: a null text is empty; an empty text is one block of 64 zero bytes; equal texts give equal streams;
damaged streams keep their good packets and count the faults, and are read on from the next two packets in step; input
columns are carried in `row`, whatever their names; repeated rows are described each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame

from corvane.llm.rows import map_text

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_DATA, STREAM_ID = 188, 0x47, 0, 0x1000, 0x0100, 0x06, 0xBD
PES_BYTES, RAP_EVERY, TICKS = 8064, 8, 3600
FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _table()


_SEEN: dict[bytes, int] = {}


def crc_mpeg(b: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section that ends in its own CRC. The tables of a stream repeat, so a few are remembered."""
    if b in _SEEN:
        return _SEEN[b]
    c = 0xFFFFFFFF
    for x in b:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    if len(_SEEN) > 256:
        _SEEN.clear()
    _SEEN[bytes(b)] = c
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _packet(pid: int, start: bool, counter: int, data: bytes, flags: int = 0, clock: bytes = b"") -> bytes:
    """One packet; an adaptation field carries flags, clock and the stuffing."""
    head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 255])
    room = PACKET - 4 - len(data)
    if not room:
        return head + bytes([0x10 | counter]) + data
    field = b"" if room == 1 else (bytes([flags]) + clock).ljust(room - 1, b"\xff")
    return head + bytes([0x30 | counter, room - 1]) + field + data


def _stamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _clock(t: int) -> bytes:
    """A program clock: 33 bits at 90 kHz, 6 reserved, 9 bits of its 300th parts, which are 0 here."""
    return ((t & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


_PSI = {
    PAT_PID: b"\x00" + _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")),
    PMT_PID: b"\x00" + _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"),
}
_TABLES = [[_packet(pid, True, c, section.ljust(PACKET - 4, b"\xff")) for pid, section in _PSI.items()] for c in range(16)]


def mux(payload: bytes) -> bytes:
    out = list(_TABLES[0])
    counter, heads = 0, [bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        body = payload[at : at + PES_BYTES]
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + body
        rap = k % RAP_EVERY == 0
        if rap and k:
            out += _TABLES[k // RAP_EVERY & 15]
        n = min(len(data), PACKET - 4 - 8)
        out.append(_packet(ES_PID, True, counter, data[:n], 0x50 if rap else 0x10, _clock((k - 1) * TICKS)))
        counter = (counter + 1) & 15
        full = n + (len(data) - n) // (PACKET - 4) * (PACKET - 4)
        for i in range(n, full, PACKET - 4):
            out.append(heads[counter] + data[i : i + PACKET - 4])
            counter = (counter + 1) & 15
        if full < len(data):
            out.append(_packet(ES_PID, False, counter, data[full:]))
            counter = (counter + 1) & 15
    return b"".join(out)


def _in_step(media: bytes, at: int) -> int:
    """The next place of a sync byte that another one follows a packet later, or the end does."""
    while (at := media.find(SYNC, at)) >= 0:
        if at + PACKET >= len(media) or media[at + PACKET] == SYNC:
            return at
        at += 1
    return len(media)


def _sections(b: bytes) -> tuple[list[bytes], bytes]:
    """The whole sections at the front of b, and what is there of the next; stuffing ends them."""
    out = []
    while len(b) >= 3 and b[0] != 0xFF:
        end = 3 + ((b[1] & 15) << 8 | b[2])
        if len(b) < end:
            break
        out.append(b[:end])
        b = b[end:]
    return out, b"" if b[:1] == b"\xff" else b


#: Fixed values of the format: stream ids whose packets have no header of their own.
PLAIN = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def _elementary(units: list[tuple[bool, list[bytes]]]) -> tuple[dict, int]:
    """Payload, timestamps and random-access points of one PID's elementary packets, and how many were faulty."""
    bodies, pts, raps, faults = [], [], [], 0
    for rap, chunks in units:
        p = b"".join(chunks)
        if len(p) < 9 or p[:3] != b"\x00\x00\x01":
            faults += 1
            continue
        length = int.from_bytes(p[4:6], "big")
        plain = p[3] in PLAIN
        if rap:
            raps.append(len(pts))
        pts.append(_time(p[9:14]) if not plain and p[7] & 0x80 and len(p) >= 14 else None)
        bodies.append(p[6 if plain else 9 + p[8] : 6 + length if length else None])
        faults += bool(length and len(p) < 6 + length)
    return {"payload": b"".join(bodies), "pts": pts, "raps": raps}, faults


def demux(media: bytes) -> dict:
    """What a stream holds, by PID in `elementary` {pid: payload, pts, raps}.

    payload, pts (one per elementary packet) and raps (indexes of those) are also given for the lowest PID; streams is
    {pid: type}; pcr the program clocks in 27 MHz; tables the good ones read; packets, cc_errors and faults are counts.
    """
    pmts: set[int] = set()
    clocks: set[int] = set()
    streams: dict[int, int] = {}
    last: dict[int, int] = {}
    held: dict[int, bytes] = {}
    units: dict[int, list] = {}
    pcr: list[int] = []
    errors = faults = n = tables = at = 0
    while at + PACKET <= len(media):
        if media[at] != SYNC:
            faults += 1
            at = _in_step(media, at + 1)
            continue
        here, end = at, at + PACKET
        at, n = end, n + 1
        b1, b3 = media[here + 1], media[here + 3]
        pid, start, counter = (b1 & 0x1F) << 8 | media[here + 2], b1 & 0x40, b3 & 15
        if pid == 0x1FFF:
            continue
        i, flags = here + 4, 0
        if b3 & 0x20:
            length = media[i]
            flags = media[i + 1] if length else 0
            i += 1 + length
        if i > end or b1 & 0x80:
            faults += 1
            continue
        if flags & 0x10 and length >= 7 and pid in clocks:
            c = int.from_bytes(media[here + 6 : here + 12], "big")
            pcr.append((c >> 15) * 300 + (c & 0x1FF))
        if not b3 & 0x10:
            continue
        before = last.get(pid)
        last[pid] = counter
        if before is not None and counter != (before + 1) & 15 and not flags & 0x80:
            if counter == before:
                continue  # a packet may be sent twice
            errors += 1
            held.pop(pid, None)
        data = media[i:end]
        if pid in streams:
            if start:
                units.setdefault(pid, []).append((bool(flags & 0x40), [data]))
            elif pid in units:
                units[pid][-1][1].append(data)
        elif (pid == PAT_PID or pid in pmts) and data:
            found: list[bytes] = []
            if start:
                new = 1 + data[0]
                if pid in held:
                    found = _sections(held.pop(pid) + data[1:new])[0]
                data = data[new:]
            elif pid in held:
                data = held.pop(pid) + data
            else:
                continue
            more, rest = _sections(data)
            if rest:
                held[pid] = rest
            for section in found + more:
                if section[0] != (0 if pid == PAT_PID else 2):
                    continue
                if len(section) < (12 if pid == PAT_PID else 16) or crc_mpeg(section):
                    faults += 1
                    continue
                tables += 1
                if pid == PAT_PID:
                    pmts |= {(section[j + 2] & 0x1F) << 8 | section[j + 3] for j in range(8, len(section) - 4, 4) if section[j] | section[j + 1]}
                    continue
                clocks.add((section[8] & 0x1F) << 8 | section[9])
                j = 12 + ((section[10] & 15) << 8 | section[11])
                while j + 5 <= len(section) - 4:
                    streams[(section[j + 1] & 0x1F) << 8 | section[j + 2]] = section[j]
                    j += 5 + ((section[j + 3] & 15) << 8 | section[j + 4])
    faults += len(held)
    elementary = {}
    for pid in sorted(streams):
        elementary[pid], bad = _elementary(units.get(pid, []))
        faults += bad
    first = next(iter(elementary.values()), {"payload": b"", "pts": [], "raps": []})
    return first | {"elementary": elementary, "streams": streams, "pcr": pcr, "tables": tables, "packets": n, "cc_errors": errors, "faults": faults}


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00")


def describe(texts: list) -> list:
    out = [[] for _ in range(7)]
    for b in texts:
        b = b or b""
        media = mux(payload_of(b))
        got = demux(media)
        p, pts, raps = got["payload"], got["pts"], got["raps"]
        feature = f"pids={','.join(f'{k}:{v}' for k, v in sorted(got['streams'].items()))};packets={got['packets']};pes={len(pts)};pts={pts[0]}-{pts[-1]};rap={'.'.join(str(pts[i]) for i in raps)};pcr={len(got['pcr'])};tables={got['tables']};cc_errors={got['cc_errors']};faults={got['faults']}"
        row = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        for col, v in zip(out, row, strict=True):
            col.append(v)
    return out


def media_columns(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` and the columns of FIELDS, from the stream as read back."""
    return map_text(docs, lambda: describe, FIELDS, text, carry)


def streams(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row`, media (the stream itself), pts (one per elementary packet) and random_access (their timestamps)."""

    def make():
        def build(texts: list) -> list:
            media = [mux(payload_of(b or b"")) for b in texts]
            got = [demux(m) for m in media]
            return [media, [g["pts"] for g in got], [[g["pts"][i] for i in g["raps"]] for g in got]]

        return build

    return map_text(docs, make, "media binary, pts array<long>, random_access array<long>", text, carry)
