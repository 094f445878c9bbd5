"""Byte-level BPE ids of whole blocks of texts, and the token file format.

Encoding. No pre-token of the byte-level pattern spans a change from non-space to white
space, so a text is cut there and each distinct piece is encoded once by the tokenizers
library; its ids are kept by the piece's hash, and its bytes are compared with those that the
ids are taken for. Ids equal those of the whole text.

Files. A token file is a series of independent zstandard frames, each holding some whole
documents, then a skippable frame with the first document and the number of documents of
each frame, then the seek table of the public zstd seekable format with a checksum of
each frame. A reader gets the footer and the frames it needs, nothing else.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import xxhash
import zstandard

from . import text as tx

#: Pieces that a worker keeps before it starts its cache anew.
CACHE = 1_000_000
#: Ids in a frame before it is closed.
FRAME_IDS = 1 << 16
NULL_ID = -(1 << 63)
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


class Encoder:
    """Ids of blocks of texts. end: an id that every text gets at its end, or None."""

    def __init__(self, path: str, end: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        # Bytes of each id: a byte-level token has one character for each byte.
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.salt = 0
        self.clear()

    @classmethod
    def of(cls, path: str, end: int | None = 0) -> Encoder:
        """The worker's encoder for a file, with what it has seen so far."""
        kept = tx.store().__dict__.setdefault("encoders", {})
        if (path, end) not in kept:
            kept[path, end] = cls(path, end)
        return kept[path, end]

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        # The bytes of the pieces, to tell those of one hash apart.
        self.raw, self.raw_used = np.zeros(1 << 18, np.uint8), 0
        self.raw_at, self.raw_n = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces, ascending by key. Those that start with white space and end with a solid
        byte split at the same places wherever they stand: they are encoded many at a time and
        told apart by the bytes of their ids."""
        plain = np.array([p[0] in b" \t\n\r\v\f" and 0x20 < p[-1] < 0x7F and b"<|" not in p for p in pieces])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        joined = [pieces[i] for i in order[: plain.sum()]]
        texts = [b"".join(joined[i : i + 256]).decode() for i in range(0, len(joined), 256)] + [pieces[i].decode() for i in order[len(joined) :]]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((x for i in ids for x in i), np.uint32, sum(map(len, ids)))
        size = np.fromiter((len(pieces[i]) for i in order), np.int64, len(order))
        ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(size), side="left") + 1
        at, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        n[order] = np.diff(ends, prepend=0)
        at[order] = self.used + ends - np.diff(ends, prepend=0)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, 2 * len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)
        own, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        if self.raw_used + len(own) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw[: self.raw_used], np.zeros(max(self.raw_used, 2 * len(own)) + 8, np.uint8)])
        self.raw[self.raw_used : self.raw_used + len(own)] = own
        self.raw_at, self.raw_n = np.insert(self.raw_at, where, self.raw_used + np.cumsum(size) - size), np.insert(self.raw_n, where, size)
        self.raw_used += len(own)

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the offset of each text in them."""
        rows = len(off) - 1
        if len(data):
            gap = tx.SPACE[data]
            solid = ~gap & (data > 0x20) & (data < 0x7F)
            solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
            cut = np.zeros(len(data), bool)
            cut[1:] = gap[1:] & solid[:-1]
            cut[off[:-1][off[:-1] < off[1:]]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
            keys, first, at = np.unique(tx.word_hashes(data, start, end, self.salt), return_index=True, return_inverse=True)
            have = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = have < len(self.keys)
            new[inside] = self.keys[have[inside]] != keys[inside]
            if new.any():
                if len(self.keys) > CACHE:
                    self.clear()
                    new[:] = True
                raw = data.tobytes()
                self.learn(keys[new], [raw[start[i] : end[i]] for i in first[new]])
                have = np.searchsorted(self.keys, keys)
            have = have[at]
            if (self.raw_n[have] != end - start).any() or not tx.same_bytes(data, start, self.raw, self.raw_at[have], end - start):
                self.salt += 1  # two pieces of one hash: start anew with another
                self.clear()
                return self.block(data, off)
            n = self.n[have].astype(np.int64)
            ids = self.pool[tx.ranges(self.at[have], self.at[have] + n)]
            where = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, off)]
        else:
            ids, where = np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if self.end is not None:
            ids = np.insert(ids, where[1:], np.uint32(self.end))
            where = where + np.arange(rows + 1)
        return ids, where


class Writer:
    """Writes one token file; it appears under its name only when complete."""

    def __init__(self, path: str, width: int = 4, level: int = 3):
        self.path, self.width, self.temp = path, width, f"{path}.{os.getpid()}.tmp"
        self.out, self.zip = open(self.temp, "wb"), zstandard.ZstdCompressor(level=level)
        self.frames, self.index, self.ids, self.docs, self.held, self.total, self.count = [], [], [], [], 0, 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id does not fit {self.width} bytes")
        self.docs.append((doc_id, len(ids)))
        self.ids.append(ids.astype(f"<u{self.width}"))
        self.held += len(ids)
        self.total += len(ids)
        self.count += 1
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        raw = struct.pack("<II", len(self.docs), self.width) + np.array(self.docs, "<i8").T.tobytes() + b"".join(x.tobytes() for x in self.ids)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((self.docs[0][0], len(self.docs)))
        self.ids, self.docs, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, "<i8").tobytes()
        table = np.array(self.frames, "<u4").tobytes()
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC))
        self.out.close()
        os.replace(self.temp, self.path)


class Reader:
    """Reads a token file by its footer; frames are decompressed one by one, and checked."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.file.seek(-9, os.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        self.file.seek(-(9 + 12 * n + 8 + 16 * n + 8), os.SEEK_END)
        kind, size = struct.unpack("<II", self.file.read(8))
        if kind != INDEX_FRAME or size != 16 * n:
            raise ValueError(f"{path} has no document index")
        self.index = np.frombuffer(self.file.read(16 * n), "<i8").reshape(n, 2)
        self.file.read(8)
        self.frames = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> list[tuple[int, np.ndarray]]:
        self.file.seek(int(self.at[k]))
        size, raw_size, check = map(int, self.frames[k])
        raw = self.unzip.decompress(self.file.read(size), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<II", raw)
        ids, lengths = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
        tokens, ends = np.frombuffer(raw, f"<u{width}", offset=8 + 16 * n), np.cumsum(lengths)
        return [(int(i), tokens[e - m : e]) for i, m, e in zip(ids, lengths, ends)]

    def __iter__(self):
        for k in range(len(self.frames)):
            yield from self.frame(k)

    def documents(self, wanted) -> dict[int, np.ndarray]:
        """Ids of some documents, from their frames alone."""
        out, firsts = {}, self.index[:, 0]
        todo = set(wanted)
        frames = {k for d in todo for k in range(max(0, int(np.searchsorted(firsts, d, "left")) - 1), int(np.searchsorted(firsts, d, "right")))}
        for k in sorted(frames):
            out.update((d, ids) for d, ids in self.frame(k) if d in todo)
        return out

    def close(self) -> None:
        self.file.close()
