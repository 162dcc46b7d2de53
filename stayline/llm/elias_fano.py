"""Elias-Fano sequences and a two-level trie shard, kept in one memory-mapped file."""

from __future__ import annotations

import numpy as np

_CHUNK = 4_096
_HEAD = np.dtype([("n", "<u8"), ("low_bits", "<u8"), ("high_bytes", "<u8"), ("low_bytes", "<u8"), ("chunks", "<u8")])


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of uint64 in about 2 + log2(range / n) bits for each value.

    The low bits are packed; the high parts are written in unary, one set bit for each value.
    Every _CHUNK-th value and the place of its bit are kept aside as points to start at.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    places = high + np.arange(n)
    bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    bits[places] = 1
    high_bytes = np.packbits(bits, bitorder="little").tobytes()
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = b"".join(
        np.packbits(
            ((values[at : at + _CHUNK, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"
        ).tobytes()
        for at in range(0, n, _CHUNK)
        if low_bits
    )
    head = np.array([(n, low_bits, len(high_bytes), len(low), -(-n // _CHUNK))], _HEAD)
    return head.tobytes() + values[::_CHUNK].tobytes() + places[::_CHUNK].astype("<u8").tobytes() + high_bytes + low


class Sequence:
    """An encoded sequence inside a buffer of bytes, such as a memory map."""

    def __init__(self, buffer: np.ndarray, at: int = 0):
        head = buffer[at : at + _HEAD.itemsize].view(_HEAD)[0]
        self.n, self.low_bits = int(head["n"]), int(head["low_bits"])
        chunks = int(head["chunks"])
        at += _HEAD.itemsize
        self.firsts = buffer[at : at + 8 * chunks].view("<u8")
        at += 8 * chunks
        self.places = buffer[at : at + 8 * chunks].view("<u8")
        at += 8 * chunks
        self.high = buffer[at : at + int(head["high_bytes"])]
        at += int(head["high_bytes"])
        self.low = buffer[at : at + int(head["low_bytes"])]
        self.end = at + int(head["low_bytes"])

    def chunk(self, k: int) -> np.ndarray:
        """The values number k * _CHUNK up to the next chunk."""
        count = min(_CHUNK, self.n - k * _CHUNK)
        begin = int(self.places[k])
        last = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-last // 8)], bitorder="little")
        places = np.flatnonzero(bits)
        places = places[places >= begin % 8][:count] + (begin - begin % 8)
        values = (places - np.arange(k * _CHUNK, k * _CHUNK + count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            size = _CHUNK * self.low_bits // 8
            packed = self.low[k * size : k * size + -(-count * self.low_bits // 8)]
            bits = np.unpackbits(packed, bitorder="little")[: count * self.low_bits].reshape(count, self.low_bits)
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            values += bits.astype(np.uint64) @ weights
        return values

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Values at sorted positions."""
        found = np.empty(len(positions), np.uint64)
        chunks = positions // _CHUNK
        for k in np.unique(chunks):
            some = slice(*np.searchsorted(chunks, (k, k + 1)))
            found[some] = self.chunk(int(k))[positions[some] - k * _CHUNK]
        return found

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted targets: the position of the first value at or above each, and that value;
        the position n and 0 where there is none."""
        position = np.full(len(targets), self.n, np.int64)
        value = np.zeros(len(targets), np.uint64)
        if not self.n or not len(targets):
            return position, value
        chunks = np.maximum(np.searchsorted(self.firsts, targets, side="left") - 1, 0)
        for k in np.unique(chunks):
            some = slice(*np.searchsorted(chunks, (k, k + 1)))
            values = self.chunk(int(k))
            local = np.searchsorted(values, targets[some], side="left")
            inside = local < len(values)
            at = np.flatnonzero(inside) + some.start
            position[at] = local[inside] + k * _CHUNK
            value[at] = values[local[inside]]
            if not inside.all() and (k + 1) * _CHUNK < self.n:
                at = np.flatnonzero(~inside) + some.start
                position[at] = (k + 1) * _CHUNK
                value[at] = self.firsts[k + 1]
        return position, value


def write_trie(path: str, keys: np.ndarray, codes: np.ndarray, context_codes: np.ndarray) -> None:
    """Write the trie of sorted distinct keys (context << 32 | word) with one code for each.

    Level one holds the contexts, a code for each, and pointers to the words that follow it;
    pointers never decrease. Level two holds the words of all contexts as one sequence, which
    is monotone because the words of context number i are shifted by i.
    """
    context = keys >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.empty(0, np.int64)
    number = np.cumsum(np.r_[True, context[1:] != context[:-1]]).astype(np.uint64) - np.uint64(1) if len(keys) else context
    words = (number << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    with open(path, "wb") as file:
        for part in (context[first], np.r_[first, len(keys)].astype(np.uint64), words):
            data = encode(part)
            file.write(np.uint64(len(data)).tobytes() + data)
        file.write(context_codes.astype(np.uint8).tobytes() + codes.astype(np.uint8).tobytes())


class Trie:
    """A written trie, opened as a memory map."""

    def __init__(self, path: str):
        buffer = np.memmap(path, np.uint8, "r")
        parts, at = [], 0
        for _ in range(3):
            size = int(buffer[at : at + 8].view("<u8")[0])
            parts.append(Sequence(buffer[at + 8 : at + 8 + size]))
            at += 8 + size
        self.contexts, self.pointers, self.words = parts
        self.context_codes = buffer[at : at + self.contexts.n]
        self.codes = buffer[at + self.contexts.n : at + self.contexts.n + self.words.n]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of sorted keys and of their contexts; 0 for what the trie does not hold.

        The context is looked up first; its number shifts the word, and the successor of the
        shifted word is sought, which counts only inside the context's pointers.
        """
        wanted = keys >> np.uint64(32)
        number, value = self.contexts.successor(wanted)
        known = (number < self.contexts.n) & (value == wanted)
        code, context_code = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        if known.any():
            number = number[known]
            context_code[known] = self.context_codes[number]
            begin, end = self.pointers.at(number).astype(np.int64), self.pointers.at(number + 1).astype(np.int64)
            target = (number.astype(np.uint64) << np.uint64(32)) | (keys[known] & np.uint64(0xFFFFFFFF))
            place, value = self.words.successor(target)
            hit = (place >= begin) & (place < end) & (value == target)
            found = np.zeros(len(target), np.uint8)
            found[hit] = self.codes[place[hit]]
            code[known] = found
        return code, context_code
