"""Language identification by cross-parsing entropy.

A language's model is the suffix automaton of a sample of its labelled text.
A text is parsed greedily: each phrase is the longest match that starts where
the last phrase ended.  Few phrases per byte, times the logarithm of the
sample's length, means low cross entropy; the language with the least wins.
(The bits that naming the language costs are added, which decides among
languages only where a text has a few words.)

The automaton becomes rows of byte classes to states that lie displaced over
each other in one array, whose slots say whose row they are of; a failed match
leads to the state after restarting with that byte.  So a model takes memory by
the transitions it has (some 1 MB for 48,000 bytes of text), not by states times
classes.  Parsing is then two lookups per byte, done in numpy for many blocks of
text at once.
Texts are parsed whole: blocks of ``BLOCK`` bytes are first parsed as if a
phrase began at each, then again from the state in which the block before ends,
up to the byte where both ways meet, until no block's first state changes.

Scale: the model is bounded: per language whole texts of at most
``sample_rows`` labelled rows and ``sample_bytes`` bytes together, by hash of
the id (rows of more than an eighth of those bytes come after all others, and
the first row is always taken).  Scoring has no shuffle; each worker builds the
tables once.

A corpus filter (``accepted``) also rejects texts of no learned language: those
for which the best language's parse takes more bits than letters drawn evenly,
by more than ``slack`` phrases, which short texts of any language may take.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is any text when nothing could be learned; ties go to the first language
by code point; rows with a null id are not learned from and not held out;
repeated rows get equal results; other columns may have any names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, ship

BLOCK = 1024
#: Bytes handled at once, which bounds a worker's memory.
SLAB = 4 << 20


def _byte_classes() -> np.ndarray:
    """A-Z as a-z, other ASCII as one separator (class 0), bytes of other
    letters as they are."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if 97 <= b <= 122:
            table[b] = b - 96
        elif 65 <= b <= 90:
            table[b] = b - 64
        elif b >= 128:
            table[b] = 27 + b - 128
    return table


CLASSES = _byte_classes()
WIDTH = 27 + 128


def normalise(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes with runs of separators made one, and where each text
    (``starts``: offsets, one more than texts) begins in the result."""
    codes = CLASSES[data]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    first = starts[:-1][starts[:-1] < len(codes)]
    keep[first] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 starts."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return steps


def displaced(rows: list[dict[int, int]]) -> tuple[list[int], int]:
    """Where each row (of class to state) begins in one array, so that no two
    rows' entries share a slot and no two rows begin at one place; and how many
    slots that takes.  The fullest rows are placed first, each kind from where
    its last one found room; rows of one entry fill what is left."""
    slots = 2 * sum(map(len, rows)) + 2 * len(rows) + 2 * WIDTH
    taken, begun, at, room = bytearray(slots), bytearray(slots), [0] * len(rows), {}
    for r in sorted(range(len(rows)), key=lambda r: -len(rows[r])):
        classes = sorted(rows[r])
        k, first = len(classes), classes[0] if classes else 0
        place = max(room.get(k, 0), first)
        while True:
            if classes:
                place = taken.find(0, place)  # the next slot that is free for the row's first entry
            begin = place - first
            if place < 0 or len(taken) < begin + WIDTH + 1:
                place = len(taken) if place < 0 else place
                taken.extend(bytes(slots))
                begun.extend(bytes(slots))
                continue
            if not begun[begin] and not any(taken[begin + c] for c in classes[1:]):
                break
            place += 1
        room[k], at[r], begun[begin] = place, begin, 1
        for c in classes:
            taken[begin + c] = 1
    return at, max(at, default=0) + WIDTH + 1


class Model:
    """Parsing tables of all languages, with one numbering of byte classes."""

    def __init__(self, samples: dict[str, tuple[bytes, float]]) -> None:
        self.langs = sorted(samples)
        self.prior = np.array([samples[k][1] for k in self.langs])
        coded = {}
        for lang, (text, _) in samples.items():
            data = np.frombuffer(text, np.uint8)
            coded[lang] = normalise(data, np.array([0, len(data)]))[0]
        used = np.unique(np.concatenate(list(coded.values()))) if coded else np.zeros(0, np.uint8)
        self.number = np.full(WIDTH, len(used), np.uint8)  # the last number: never seen, matches nothing
        self.number[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.tables, self.log = [], []
        for lang in self.langs:
            steps = suffix_automaton(self.number[coded[lang]].tolist())
            # one more state, after a byte that matches nothing: a phrase by itself
            lost = len(steps)
            steps.append({})
            steps[0] = {c: lost for c in range(self.width)} | steps[0]
            at, size = displaced(steps)
            # twice where the next state's row begins, plus 1 where a phrase ended
            to, of = np.zeros(size, np.int32), np.full(size, -1, np.int32)
            for begin, row in zip(at, steps):
                for c, state in row.items():
                    to[begin + c], of[begin + c] = at[state] * 2, begin
            restart = np.array([at[steps[0][c]] * 2 + 1 for c in range(self.width)], np.int32)
            self.tables.append((to, of, restart, at[0]))
            self.log.append(np.log2(max(2, len(coded[lang]))))

    def phrases(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        codes = self.number[codes]
        sizes = np.diff(starts)
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        at = starts[:-1][owner] + nth * BLOCK
        long = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-long, kind="stable")
        owner, at, long = owner[order], at[order], long[order]
        active = np.searchsorted(-long, -np.arange(1, BLOCK + 1), side="right")  # blocks with more than t bytes
        before = np.full(len(owner), -1)  # the block before each, in this order
        where = np.empty(len(owner), np.int64)
        where[order] = np.arange(len(owner))
        later = np.flatnonzero(nth[order] > 0)
        before[later] = where[order[later] - 1]
        cells = codes.astype(np.int32)
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for j, (to_of, row_of, restart, start) in enumerate(self.tables):

            def step(here: np.ndarray, cell: np.ndarray) -> np.ndarray:
                slot = here + cell
                return np.where(row_of[slot] == here, to_of[slot], restart[cell])

            state, count = np.full(len(owner), start, np.int32), np.zeros(len(owner), np.int64)
            path = np.zeros((BLOCK, len(owner)), np.int32)
            for t in range(BLOCK):
                if not (m := active[t]):
                    break
                to = step(state[:m], cells[at[:m] + t])
                path[t, :m] = to
                count[:m] += to & 1
                state[:m] = to >> 1
            first = np.full(len(owner), start, np.int32)
            while True:  # until each block starts where the one before it ends
                now = np.where(before >= 0, state[before], start).astype(np.int32)
                again = np.flatnonzero(now != first)
                if not len(again):
                    break
                first, run, t = now, again, 0
                here = now[again]
                while len(run) and t < BLOCK:
                    live = long[run] > t
                    run, here = run[live], here[live]
                    to, was = step(here, cells[at[run] + t]), path[t, run]
                    path[t, run] = to
                    count[run] += (to & 1) - (was & 1)
                    here = to >> 1
                    state[run[long[run] == t + 1]] = here[long[run] == t + 1]
                    apart = here != was >> 1
                    run, here, t = run[apart], here[apart], t + 1
            # the last phrase of a text ends with it
            out[:, j] = np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64) + (sizes > 0)
        return out

    def predict(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and gain of each text; score is how far, from 0 to 1,
        the best language's entropy lies below the second's, and gain how many
        phrases' bits its parse saves against letters drawn evenly."""
        codes, at = normalise(data, starts)
        sizes = np.maximum(np.diff(at), 1)
        entropy = (self.phrases(codes, at) * np.array(self.log) + self.prior) / sizes[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        gain = (np.log2(self.width) - low) * sizes / np.array(self.log)[best]
        if len(self.langs) == 1:
            return [self.langs[0]] * len(best), np.ones(len(best)), gain
        second = np.partition(entropy, 1, axis=1)[:, 1]
        return [self.langs[b] for b in best], 1 - low / second, gain


def _has_letter(data: np.ndarray, starts: np.ndarray, text_of) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = (CLASSES[data] > 0) & (data < 128)
    before = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = before[starts[1:]] > before[starts[:-1]]
    for i in np.flatnonzero(~out & (np.diff(starts) > 0)):
        out[i] = any(ch.isalpha() for ch in text_of(int(i)))
    return out


#: One worker's last model; a worker serves one model at a time.
_READY: dict[int, Model] = {}


def _model(key: int, samples: dict[str, tuple[bytes, float]]) -> Model:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Model(samples)
    return _READY[key]


def slabs(offsets: np.ndarray, most: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = end


def text_buffer(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each row; null as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def _predictor(shared, key: int, text: str, keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = None
        for batch in batches:
            data, offsets = text_buffer(batch, text)
            langs, scores, gains = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if shared.value:
                model = model or _model(key, shared.value)
                for a, b in slabs(offsets):
                    part, starts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    got, score, gain = model.predict(part, starts)
                    letters = _has_letter(part, starts, lambda i: part[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace"))
                    for i in np.flatnonzero(letters):
                        langs[a + i], scores[a + i], gains[a + i] = got[i], score[i], gain[i]
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gains, pa.float64())], names=[*keep, "lang_pred", "score", "gain"])

    return run


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id", sample_rows: int = 64, sample_bytes: int = 48_000) -> dict[str, tuple[bytes, float]]:
    """Per language a bounded sample of whole texts and the bits that naming
    it costs, from the counts of all labelled rows."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.octet_length(text).alias("size"), F.xxhash64(F.col(order), F.lit(5)).alias("h"))
    by = Window.partitionBy("lang").orderBy(F.col("size") > sample_bytes // 8, "h", F.xxhash64("text"))
    picked = rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= sample_rows)
    upto = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = picked.withColumn("upto", upto).where((F.col("upto") <= sample_bytes) | (F.col("k") == 1))
    out: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    every = sum(counts.values())
    return {k: (b"\n".join(v), float(np.log2(every / counts[k]))) for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, tuple[bytes, float]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text, if not given) with
    lang_pred, score and gain."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, text]))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double", "gain double"])
    return rows.mapInArrow(_predictor(shared, hash(tuple(sorted(samples.items()))), text, keep), schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", fold: int = 4, held: int = 2, **kw) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.  Rows whose id's
    crc32 modulo ``fold`` is ``held`` are never learned from."""
    part = F.pmod(crc_of_id(F.col(id_col)), F.lit(fold))
    samples = learn(docs.where(part != held), order=id_col, **kw)
    out = identify(docs, samples, keep=[id_col])
    return out.select(id_col, F.coalesce(part == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, slack: float = 4.0, id_col: str = "doc_id", text: str = "text", fold: int = 4, held: int = 2) -> DataFrame:
    """``docs`` without those of no language: ``und``, or a gain below
    -``slack`` phrases.  The columns stay."""
    part = F.pmod(crc_of_id(F.col(id_col)), F.lit(fold))
    samples = learn(docs.where(part != held), order=id_col)
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    out = identify(rows, samples, text=named[text], keep=list(named.values()))
    return out.where((F.col("lang_pred") != "und") & (F.col("gain") >= -slack)).select(*[F.col(n).alias(c) for c, n in named.items()])
