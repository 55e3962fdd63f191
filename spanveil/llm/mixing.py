"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased (A-Z) words, each followed by a blank, and an end mark. Bytes become
symbols of five bits: the most frequent bytes have one, others an escape and two more. Each bit is
predicted under several contexts: the topic of the row so far together with the word so far, or with
its last 5, 3 or 2 symbols. A hash of context and bits so far names a slot of a table, which holds
the log odds that all training words showed there and how far they are trusted (by their number).
The topic is the one of most marker words before, in the same row; markers come from k-means over the
``MARKERS`` most frequent words, by how many of all training rows hold two of them together.

A mixer adds the log odds, each for the share of trust that longer contexts leave, with weights
gated by the bit's place, and learns from every bit as it reads; a bias per place refines its
output. Weights start anew every ``BLOCK`` symbols, so blocks of many documents are read side by
side. What the tables say is looked up once per distinct word of ``GROUP`` symbols, before the mixer reads. The sum of the log probabilities is the score, spelling of unknown words included.

The base score is that of a unigram model with one added to each count. Training counts every word
of every training row. Words with the highest counts, at most ``FREQUENT`` of them (whole levels of
counts), travel to the tasks; the counts of all others come by a shuffle of the tokens that are not
among them. Every context learns every word. The table of the word-so-far context grows with the
vocabulary (``table_bits``), the others have a fixed size; all travel to the tasks whole.

A null text is empty: its only token is the end. Repeated rows are scored each; rows with a null id
count as an empty id. An empty table gives no rows; without training rows every count is 0. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanveil.llm.common import hold
from spanveil.llm.words import Words, mix, powers, slices, words

U = np.uint64
#: Bytes with a symbol of their own, in the order of their codes; 31 is the escape.
SYMBOLS = b" \nabcdefghijklmnopqrstuvwxyz.,\xc3"
ESCAPE, BITS = 31, 5
ORDERS = (0, 5, 3, 2)  # 0: the whole word so far
TABLE_BITS = (22, 20, 18, 16)
SPREAD = 0.3  # shorter contexts learn the spelling of words more than their use: counts to this power
ADDED = (0.05, 0.1, 0.2, 0.4)  # added to each count
PRIOR = (60.0, 100.0, 80.0, 0.0)  # counts at which a context is trusted by half
TOPICS, MARKERS = 8, 512
BLOCK, FREQUENT, CHUNK = 1024, 1 << 20, 3 << 20
PIECE = 1 << 17  # symbols whose contexts are hashed at once
GROUP = 1 << 21  # symbols that are scored at once
ALIKE = 10  # symbols at the start of words that are compared, in one integer
LOOKED_UP = 1 << 14  # symbols whose slots are looked up at once, as many as fit in a cache
PART_BITS, WORDS_PER_TABLE = 16, 1_000_000
START, RATE, BIAS_RATE, SCALE, LIMIT = 1.05, 0.02, 0.02, 16.0, 14.0
END_WORD = int(mix(np.array([0x0A], U), 77)[0])


def offsets(bits: tuple[int, ...]) -> tuple[int, ...]:
    """Where each context's table begins, and the end of the last."""
    return tuple(int(x) for x in np.concatenate([[0], np.cumsum([1 << b for b in bits])]))


OFFSETS = offsets(TABLE_BITS)


def table_bits(vocabulary: int) -> tuple[int, ...]:
    """Bits of each table: that of the whole word has at least 8 slots a word."""
    return (max(TABLE_BITS[0], (8 * vocabulary - 1).bit_length() if vocabulary else 0), *TABLE_BITS[1:])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _codes() -> tuple[np.ndarray, np.ndarray]:
    code = np.full(256, ESCAPE, np.int64)
    code[np.frombuffer(SYMBOLS, np.uint8)] = np.arange(len(SYMBOLS))
    return code, np.where(code == ESCAPE, 3, 1)


def byte_stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, blanks and end marks; where each row's begin; where words and end marks begin."""
    size = w.end - w.start
    rows = len(w.first) - 1
    place = np.concatenate([[0], np.cumsum(size + 1)])
    first = place[w.first] + np.arange(rows + 1)
    out = np.full(first[-1], 0x20, np.uint8)
    begin = place[:-1] + w.row
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inner] = w.data[np.repeat(w.start, size) + inner]
    out[first[1:] - 1] = 0x0A
    return out, first, np.insert(begin, w.first[1:], first[1:] - 1)


def symbol_stream(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of bytes, and where each byte's begin (and the end)."""
    code, width = _codes()
    size = width[data]
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(place[-1], np.uint8)
    out[place[:-1]] = code[data]
    rare = np.flatnonzero(size == 3)
    out[place[rare] + 1], out[place[rare] + 2] = data[rare] >> 5, data[rare] & 31
    return out, place


def _kinds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and the number of each word's among them."""
    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def topics(w: Words, markers: tuple[np.ndarray, np.ndarray], kinds: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Topic of each word and end mark: that of most markers before it in its row; TOPICS if none."""
    if kinds is None:
        kinds, of = _kinds(w.hash)
    topic = np.full(len(kinds), TOPICS, np.int8)
    if len(markers[0]):
        at = np.searchsorted(markers[0], kinds)
        at[at == len(markers[0])] = 0
        topic = np.where(markers[0][at] == kinds, markers[1][at], TOPICS)
    mine = topic[of]
    best, most = np.full(len(mine) + 1, TOPICS, np.int64), np.zeros(len(mine) + 1, np.int64)
    ends = np.zeros((len(w.first) - 1,), np.int64) + TOPICS
    most_end = np.zeros(len(ends), np.int64)
    row = w.row
    for k in range(TOPICS):
        total = np.concatenate([[0], np.cumsum(mine == k)])
        here = total[:-1] - total[w.first[:-1]][row]
        more = here > most[:-1]
        best[:-1][more], most[:-1][more] = k, here[more]
        last = total[w.first[1:]] - total[w.first[:-1]]
        more = last > most_end
        ends[more], most_end[more] = k, last[more]
    return np.insert(best[:-1], w.first[1:], ends)


def _together(hashes: np.ndarray):
    """How many rows hold two words of a sorted list together, a row of the matrix each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(hashes)
        total = np.zeros((m, m), np.int64)
        for batch in slices(batches, "text", CHUNK):
            w = words(batch.column("text"))
            at = np.minimum(np.searchsorted(hashes, w.hash), m - 1)
            there = hashes[at] == w.hash
            row, at = np.divmod(np.unique(w.row[there].astype(np.int64) * m + at[there]), m)
            of = np.unique(row, return_inverse=True)[1]
            for since in range(0, int(of[-1]) + 1 if len(of) else 0, 4096):
                a, b = np.searchsorted(of, [since, since + 4096])
                held = np.zeros((min(4096, int(of[-1]) + 1 - since), m), np.float32)
                held[of[a:b] - since, at[a:b]] = 1
                total += (held.T @ held).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(
                [r.astype("<i8").tobytes() for r in total], pa.binary())], ["i", "counts"])

    return run


def _sum_rows(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in part.column("counts"))
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def find_markers(given: DataFrame, vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words that tell topics (languages, mostly) apart: k-means over the most frequent words of all rows."""
    none = np.zeros(0, U), np.zeros(0, np.int64)
    top = vocabulary.where(F.col("h") != _signed(END_WORD)).orderBy(F.desc("n"), "h").limit(MARKERS).toArrow()
    hashes = np.sort(top.column("h").to_numpy().view(np.uint64))
    if len(hashes) < TOPICS:
        return none
    rows = given.select("text").mapInArrow(_together(hashes), "i int, counts binary").groupBy("i").applyInArrow(
        _sum_rows, "i int, counts binary").collect()
    both = np.stack([np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["i"])]).astype(np.float64)
    like = both / np.sqrt(np.outer(both.diagonal(), both.diagonal()))
    seen = like / np.linalg.norm(like, axis=1, keepdims=True)
    centres = [seen[np.argmax(both.diagonal())]]
    while len(centres) < TOPICS:  # each next centre is the word least like those there
        centres.append(seen[np.argmin(np.max(seen @ np.array(centres).T, axis=1))])
    centre = np.array(centres)
    for _ in range(20):
        group = np.argmax(seen @ centre.T, axis=1)
        centre = np.stack([seen[group == k].mean(axis=0) if (group == k).any() else centre[k] for k in range(TOPICS)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    share = np.stack([like[:, group == k].mean(axis=1) if (group == k).any() else np.zeros(len(like)) for k in range(TOPICS)])
    share /= share.sum(axis=0)
    sure = share.max(axis=0) > 0.4
    return hashes[sure], share.argmax(axis=0)[sure]


def contexts(symbols: np.ndarray, starts: np.ndarray, topic: np.ndarray, bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """Slot of the first bit of each symbol, under each context. ``starts``: where words begin; their topics.

    Contexts end at the start of their word, so pieces of whole words are hashed apart: only the slots are held for all.
    """
    place = offsets(bits)
    out = np.empty((len(ORDERS), len(symbols)), np.int32 if place[-1] < 1 << 31 else np.int64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(symbols), PIECE)))
    cuts = np.append(cuts[cuts < len(starts)], len(starts))
    ends = np.append(starts, len(symbols))
    for a, b in zip(cuts, cuts[1:]):
        since, until = ends[a], ends[b]
        _contexts(symbols[since:until], starts[a:b] - since, topic[a:b], bits, place, out[:, since:until])
    return out


def _contexts(symbols: np.ndarray, starts: np.ndarray, topic: np.ndarray, bits: tuple[int, ...], place: tuple[int, ...],
              out: np.ndarray) -> None:
    p, inverse = powers(len(symbols))
    total = np.zeros(len(symbols) + 1, U)
    np.cumsum((symbols.astype(U) + U(1)) * p[:len(symbols)], out=total[1:], dtype=U)
    at = np.arange(len(symbols))
    length = np.diff(np.append(starts, len(symbols)))
    begin, about = np.repeat(starts, length), np.repeat(mix(topic.astype(U), 49), length)
    for c, order in enumerate(ORDERS):
        since = np.maximum(begin, at - order) if order else begin
        h = mix((total[at] - total[since]) * inverse[since] + (at - since).astype(U) + about, 50 + c)
        out[c] = (h >> U(64 - bits[c])).astype(out.dtype) + place[c]


def _nodes(bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """What the bits so far (a leading 1 before them) change in a slot, under each context."""
    h = mix(np.arange(1 << BITS, dtype=U), 60)
    return np.stack([(h >> U(64 - b)).astype(np.int32 if max(bits) < 32 else np.int64) for b in bits])


def count_bits(vocabulary: list[bytes], topic: np.ndarray, counts: np.ndarray, whole: np.ndarray, table: np.ndarray,
               bits: tuple[int, ...] = TABLE_BITS, apart: list | None = None) -> None:
    """Add the bits of words (each with its blank or end mark) to a table of (slot, bit) counts.

    ``whole``: which words the context of the whole word learns, too. ``apart``: takes what that context
    counts as (places, counts); the table is then that of the other contexts.
    """
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    first = np.concatenate([[0], np.cumsum(size)])
    symbols, place = symbol_stream(np.frombuffer(b"".join(vocabulary), np.uint8))
    first = place[first]
    slots, weight = contexts(symbols, first[:-1], topic, bits), np.repeat(counts ** SPREAD, np.diff(first))
    top = np.repeat(np.where(whole, counts, 0.0), np.diff(first))
    node, change, place = np.ones(len(symbols), np.int64), _nodes(bits), offsets(bits)
    from_ = 0 if apart is None else place[1]
    for bit in range(BITS - 1, -1, -1):
        y = symbols >> bit & 1
        for c in range(len(ORDERS)):
            at = (((slots[c] - place[c]) ^ change[c][node]) + place[c]).astype(np.int64) * 2 + y
            if c or apart is None:
                np.add.at(table, at - 2 * from_, weight if c else top)
            else:
                apart.append((at, top))
        node = node * 2 + y


def log_odds(table: np.ndarray, offset: int = 0, bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """Per slot: log odds (high byte) and trust (low byte) from its two counts."""
    pairs = table.reshape(-1, 2).astype(np.float64)
    n = pairs.sum(axis=1)
    order = np.searchsorted(offsets(bits), np.arange(len(n)) + offset, side="right") - 1
    added, prior = np.array(ADDED)[order], np.array(PRIOR)[order]
    odds = np.clip(np.rint(np.log((pairs[:, 1] + added) / (pairs[:, 0] + added)) * SCALE), -127, 127).astype(np.int16)
    trust = np.where(n > 0, n / np.maximum(n + prior, 1e-9), 0.0)
    return (odds << 8 | np.rint(255 * trust).astype(np.int16)).astype(np.int16)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each block of a symbol stream."""
    blocks = -(-np.diff(first) // BLOCK)
    row = np.repeat(np.arange(len(blocks)), blocks)
    start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    return row, start, np.minimum(first[row + 1] - start, BLOCK)


def mixer_inputs(symbols: np.ndarray, slots: np.ndarray, table: np.ndarray, bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """What each context says of each bit of each symbol: (symbol, context * ``BITS`` + bit).

    A context speaks for the share that it is trusted with (by its counts) of what longer ones leave.
    """
    change, place = _nodes(bits), offsets(bits)
    out = np.empty((len(symbols), len(ORDERS) * BITS), np.float32)
    for since in range(0, len(symbols), LOOKED_UP):
        here = symbols[since:since + LOOKED_UP].astype(np.int64)
        found = np.empty((len(ORDERS), BITS, len(here)), np.float32)
        for b in range(BITS):
            node, left = here >> (BITS - b) | 1 << b, None
            for c, (start, end) in enumerate(zip(place, place[1:])):  # longer contexts first
                entry = table[start:end].take((slots[c, since:since + LOOKED_UP] - slots.dtype.type(start)) ^ change[c].take(node))
                odds, share = (entry >> 8).astype(np.float32), (entry & 255).astype(np.float32)
                odds /= np.float32(SCALE)
                share /= np.float32(255)
                if left is None:
                    left = 1 - share
                else:
                    share *= left
                    left -= share
                np.multiply(odds, share, out=found[c, b])
        out[since:since + LOOKED_UP] = found.reshape(-1, len(here)).T
    return out


def _mix_blocks(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, inputs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Natural-log probability of each block; ``inputs[of[i]]`` are those of symbol i.

    Blocks are read side by side, and so are the bits of a symbol: each place has weights of its own.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    lanes = len(start)
    weights = np.full((len(ORDERS), BITS, lanes), START, np.float32)
    bias, logs = np.zeros((BITS, lanes), np.float32), np.zeros(lanes)
    rate, bias_rate = np.float32(RATE), np.float32(BIAS_RATE)
    against_of = (1 - 2 * (np.arange(1 << BITS)[None] >> np.arange(BITS - 1, -1, -1)[:, None] & 1)).astype(np.float32)  # -1 where a bit is 1
    last = 0
    for t in range(int(length[0]) if lanes else 0):
        n = int(np.searchsorted(-length, -t, side="left"))  # lanes still open
        if n != last:
            w, lean, last = weights[:, :, :n], bias[:, :n], n
            x = np.empty((len(ORDERS), BITS, n), np.float32)
            z, e, q, against = (np.empty((BITS, n), np.float32) for _ in range(4))
        at = start[:n] + t
        x.reshape(-1, n)[:] = inputs.take(of.take(at), axis=0).T
        against_of.take(symbols.take(at), axis=1, out=against, mode="clip")
        np.einsum("cbl,cbl->bl", w, x, out=z)
        z += lean
        np.clip(z, -LIMIT, LIMIT, out=z)
        z *= against
        np.exp(z, out=e)
        np.add(e, np.float32(1), out=q)
        logs[:n] -= np.log(np.multiply.reduce(q, axis=0))
        e /= q
        e *= against
        np.multiply(e, rate, out=z)
        x *= z
        w -= x
        e *= bias_rate
        lean -= e
    out = np.empty(lanes)
    out[order] = logs
    return out


def mix_scores(symbols: np.ndarray, first: np.ndarray, slots: np.ndarray, table: np.ndarray,
               bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """Natural-log probability of each row of a symbol stream, from the slots of its symbols.

    Weights start at 1: the mixer learns how far to follow each context.
    """
    row, start, length = _blocks(first)
    logs = _mix_blocks(symbols, start, length, mixer_inputs(symbols, slots, table, bits), np.arange(len(symbols)))
    return np.bincount(row, logs, minlength=len(first) - 1)


def _prefixes(symbols: np.ndarray, starts: np.ndarray, size: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols to look up, and for each symbol the number of its equal among them.

    Words of a topic that begin alike, up to ``ALIKE`` symbols, have equal contexts there.
    """
    code = topic.astype(U) << U(6 * ALIKE)  # in six bits each: 0 past the end of a word
    for j in range(ALIKE):
        long = np.flatnonzero(size > j)
        code[long] |= (symbols[starts[long] + j] + U(1)) << U(6 * (ALIKE - 1 - j))
    order = np.argsort(code)
    code, starts, size = code[order], starts[order], size[order]
    there, equal = np.ones(len(symbols), bool), np.arange(len(symbols), dtype=np.int32)
    for j in range(ALIKE):
        part = code >> U(6 * (ALIKE - 1 - j))
        new = np.append(True, part[1:] != part[:-1])
        first = starts[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
        long = np.flatnonzero(~new & (size > j))
        there[starts[long] + j] = False
        equal[starts[long] + j] = first[long] + j
    return there, (np.cumsum(there, dtype=np.int32) - np.int32(1))[equal]


def score_words(data: np.ndarray, first: np.ndarray, begin: np.ndarray, kind: np.ndarray, topic: np.ndarray, table: np.ndarray,
                bits: tuple[int, ...] = TABLE_BITS) -> np.ndarray:
    """Natural-log probability of each row of a byte stream. ``kind``: equal numbers for equal words.

    No context reaches over the start of its word, so each distinct word of a topic is looked up once for
    all blocks of ``GROUP`` symbols together.
    """
    symbols, place = symbol_stream(data)
    first, begin = place[first], np.append(place[begin], place[-1])
    row, start, length = _blocks(first)
    key, logs = kind * (TOPICS + 1) + topic, np.empty(len(row))
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(start, start[a] + GROUP)))
        until = int(np.searchsorted(begin, start[b - 1] + length[b - 1]))
        while begin[until] - start[b - 1] > GROUP:  # a very long word is looked up once, so its blocks go together
            b = max(b + 1, int(np.searchsorted(start, begin[until])))
            until = int(np.searchsorted(begin, start[b - 1] + length[b - 1]))
        since = int(np.searchsorted(begin, start[a], side="right")) - 1
        keys = key[since:until]
        number = np.full(int(keys.max()) + 1, -1, np.int64)
        number[keys[::-1]] = np.arange(len(keys) - 1, -1, -1)  # the first word of each key
        one = number[keys]
        ones = np.flatnonzero(one == np.arange(len(keys)))
        size = np.diff(begin[since:until + 1])
        place_of = np.zeros(len(keys), np.int64)
        place_of[ones[1:]] = np.cumsum(size[ones])[:-1]
        inner = np.arange(begin[since], begin[until]) - np.repeat(begin[since:until], size)
        of = (np.repeat(place_of[one], size) + inner).astype(np.int32)
        held = np.zeros(len(keys), bool)
        held[ones] = True
        some = symbols[begin[since]:begin[until]][np.repeat(held, size)]
        slots = contexts(some, place_of[ones], topic[since:until][ones], bits)
        there, at = _prefixes(some, place_of[ones], size[ones], topic[since:until][ones])
        logs[a:b] = _mix_blocks(symbols[begin[since]:begin[until]], start[a:b] - begin[since], length[a:b],
                                mixer_inputs(some[there], slots[:, there], table, bits), at.take(of))
        a = b
    return np.bincount(row, logs, minlength=len(first) - 1)


def _count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a task with their counts; end marks are words, too."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        hashes, of = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        held[:] = [(hashes, np.bincount(of, np.concatenate([n for _, n in held])).astype(np.int64))]

    def rows() -> pa.RecordBatch:
        hashes, counts = held.pop()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["h", "n"])

    for batch in slices(batches, "text", GROUP):
        hashes, of = _kinds(words(batch.column("text")).hash)
        held.append((np.append(hashes, U(END_WORD)), np.append(np.bincount(of, minlength=len(hashes)), len(batch))))
        if sum(len(h) for h, _ in held) > 600_000:
            merge()
            if len(held[0][0]) > 400_000:
                yield rows()
    if held:
        merge()
        yield rows()


def _count_words(markers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of a task by topic, with their counts; end marks are words, too."""
        held: list[tuple] = []

        def merge() -> None:
            keys, hashes, topic, counts = (np.concatenate([h[i] for h in held]) for i in range(4))
            _, at, of = np.unique(keys, return_index=True, return_inverse=True)
            held[:] = [(keys[at], hashes[at], topic[at], np.bincount(of, counts).astype(np.int64),
                        pa.concat_arrays([h[4] for h in held]).take(pa.array(at)))]

        def rows() -> pa.RecordBatch:
            _, hashes, topic, counts, spelled = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(topic.astype(np.int32)),
                                               spelled, pa.array(counts)], ["h", "k", "word", "n"])

        for batch in slices(batches, "text", GROUP):
            w = words(batch.column("text"))
            kinds, of = _kinds(w.hash)
            topic = topics(w, markers, kinds, of)
            kind = np.insert(of.astype(np.int64), w.first[1:], len(kinds)) * (TOPICS + 1) + topic
            counts, at = np.bincount(kind), np.zeros((len(kinds) + 1) * (TOPICS + 1), np.int64)
            at[kind] = np.arange(len(kind))
            there = np.flatnonzero(counts)
            counts, at = counts[there], at[there]
            hashes, topic = np.append(kinds, U(END_WORD))[there // (TOPICS + 1)], topic[at]
            data, _, begin = byte_stream(w)
            spelled = pa.Array.from_buffers(pa.large_binary(), len(begin), [
                None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)])  # blanks included
            held.append((mix(hashes + topic.astype(U), 70), hashes, topic, counts, spelled.take(pa.array(at)).cast(pa.binary())))
            if sum(len(h[0]) for h in held) > 600_000:
                merge()
                if len(held[0][0]) > 400_000:
                    yield rows()
        if held:
            merge()
            yield rows()

    return run


def _tables(bits: tuple[int, ...]):
    """Counts per part of 2 ** ``PART_BITS`` slots: ``at`` names the places, null means all in order.

    A grown table of the whole word would not fit in a task; of it only the places that count are sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, width = offsets(bits), ["part", "at", "counts"], 2 << PART_BITS
        grown = bits[0] > TABLE_BITS[0]
        since = place[1] if grown else 0
        table = np.zeros(2 * (place[-1] - since))
        for batch in batches:
            apart = [] if grown else None
            count_bits(batch.column("word").to_pylist(), batch.column("k").to_numpy(), batch.column("n").to_numpy().astype(np.float64),
                       np.ones(len(batch), bool), table, bits, apart)
            if apart:
                at, of = np.unique(np.concatenate([a for a, _ in apart]), return_inverse=True)
                total = np.bincount(of, np.concatenate([n for _, n in apart])).astype("<f4")
                part, first = np.unique(at // width, return_index=True)
                cut = lambda x: [p.tobytes() for p in np.split(x, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cut((at % width).astype("<i4")), pa.binary()),
                                                  pa.array(cut(total), pa.binary())], names)
        if table.any():
            parts = table.astype("<f4").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32) + (since >> PART_BITS)), pa.nulls(len(parts), pa.binary()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return run


def _add(bits: tuple[int, ...]):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        total = np.zeros(2 << PART_BITS)
        for at, counts in zip(part.column("at"), part.column("counts")):
            place = np.frombuffer(at.as_py(), "<i4") if at.is_valid else slice(None)
            total[place] += np.frombuffer(counts.as_py(), "<f4")
        odds = log_odds(total, key[0].as_py() << PART_BITS, bits)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "odds": pa.array([odds.tobytes()], pa.binary())})

    return run


def _score(frequent, odds, markers, bits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value[0], np.uint64)
        counts = np.frombuffer(frequent.value[1], np.int64)
        table = np.frombuffer(odds.value, np.int16)
        logs = np.log10(counts + 1.0)
        for batch in slices(batches, "text", GROUP):
            w = words(batch.column("text"))
            rows = len(batch)
            kinds, of = _kinds(w.hash)
            at = np.searchsorted(known, kinds)
            at[at == len(known)] = 0
            there = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
            value = np.where(there, logs[at] if len(known) else 0.0, 0.0)
            row = w.row
            base = np.bincount(row, value[of], minlength=rows)
            n_known = np.bincount(row[there[of]], minlength=rows)
            rest = w.hash[~there[of]].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~there[of]], minlength=rows))]).astype(np.int32)
            data, first, begin = byte_stream(w)
            kind = np.insert(of.astype(np.int64), w.first[1:], len(kinds))  # end marks are words, too
            score = score_words(data, first, begin, kind, topics(w, markers, kinds, of), table, bits) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc"), pa.array(np.diff(w.first) + 1), pa.array(n_known),
                 pa.array(base), pa.array(score), pa.array(np.diff(first)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(rest))],
                ["rid", "doc", "n_tokens", "known", "logs", "score", "bytes", "rest"])

    return run


def language_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                    frequent: int = FREQUENT) -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte.

    ``train``: which rows to learn from; others are only scored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"), train.alias("train"))
    kind = given.schema["doc"].dataType.simpleString()
    learned = given.where("train").select(F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = hold(learned.mapInArrow(_count_kinds, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "vocabulary")
    markers = find_markers(learned, vocabulary)
    pairs = hold(learned.mapInArrow(_count_words(markers), "h long, k int, word binary, n long").groupBy("h", "k").agg(
        F.min("word").alias("word"), F.sum("n").alias("n")), "pairs")
    sizes = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    denominator = math.log10(sizes["n"] + sizes["v"] + 1)

    # whole levels of counts from the top, as long as they are few enough
    least, total = 1 << 62, 0
    for r in vocabulary.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["n"]
    top = vocabulary.where(F.col("n") >= least).toArrow()
    hashes, counts = (top.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(hashes.view(np.uint64))
    known = spark.sparkContext.broadcast((hashes.view(np.uint64)[order].tobytes(), counts[order].tobytes()))

    # each task makes tables of a fixed size, so that many words share a task
    tasks, bits = max(1, -(-sizes["v"] // WORDS_PER_TABLE)), table_bits(sizes["v"])
    found = {r["part"]: r["odds"] for r in pairs.select("word", "k", "n").repartition(tasks).mapInArrow(
        _tables(bits), "part int, at binary, counts binary").groupBy("part").applyInArrow(
        _add(bits), "part int, odds binary").toLocalIterator()}
    none = log_odds(np.zeros(2)).tobytes() * (1 << PART_BITS)
    odds = b"".join(found.get(part, none) for part in range(offsets(bits)[-1] >> PART_BITS))

    rows = hold(given.select("doc", "text").withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _score(known, spark.sparkContext.broadcast(odds), markers, bits),
        f"rid long, doc {kind}, n_tokens long, known long, logs double, score double, bytes long, rest array<bigint>"), "scores")
    rare = rows.select("rid", F.explode("rest").alias("h")).join(
        vocabulary.where(F.col("n") < least), "h")
    rare = rare.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    end = math.log10(vocabulary.where(F.col("h") == _signed(END_WORD)).agg(F.max("n")).first()[0] + 1) if sizes["n"] else None
    return rows.join(rare, "rid", "left").select(
        F.col("doc").alias(key), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(end is not None))).alias("n_known"),
        F.lit(int(sizes["n"])).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end or 0.0)
         - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        "score", (-F.col("score") * F.lit(math.log2(10)) / F.col("bytes")).alias("bits_per_byte"))
