"""Byte-level BPE encoding and decoding with a lazily determinised transducer."""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import os
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from shelltrail.llm.common import tidy

#: What a worker remembers: states of the transducer (about 450 bytes each), ids of whole pieces (220 bytes), verdicts on
#: pairs and last tokens that stand for others (100 bytes), what ends and begins in a suffix (300 bytes); some 150 MB in all.
#: Of the pieces and verdicts the older half goes when there are too many.
MOST_STATES = 150_000
MOST_SHAPES = 40_000
#: Tokens that can go on from a place, for which last tokens are told apart by what fits them only.
FEW = 8
MOST_PIECES = 200_000
MOST_PAIRS = 200_000
#: The longest piece whose output is remembered, in bytes, and ids after which a record batch goes out.
LONGEST_PIECE = 64
IDS_OUT = 1 << 18

#: Before the first token; at a place where no later token can begin.
NOTHING, CLOSED = -1, -2
KINDS = (pa.int64(), pa.string(), pa.string())


def vocabulary(name_or_path: str) -> bytes:
    """The content of a rank file: of the installed public tokenizers by name, or any by path."""
    if os.sep not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as file:
        return file.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Transducer:
    """Reads bytes of one piece, writes token ids.

    The tokens of a piece are those of merging by rank. Two facts make that a left-to-right machine. The tokens of a
    prefix are the tokens of a shorter prefix and one last token; and a row of tokens is the right one exactly if each
    neighbouring pair, merged by itself, stays as it is. So the last token after a byte is the longest token that ends
    there and fits the last token at its start. Only so many bytes back matter as can still begin a token: a state is
    the longest suffix of the read bytes that a token begins with, and the last tokens at the places in it where one can.

    Of a last token only counts which later tokens fit it: where at most FEW tokens can go on, one last token stands for all
    that the same ones fit, and a place that none fits is given up. So many prefixes share a state.

    States and transitions are made when a text first needs them, and kept: at most MOST_STATES, then the machine starts
    anew. Later tokens begin within the state's suffix, so what all its places agree on is written (`feed`): the lookahead
    is bounded by the longest token. `outputs` keeps what short pieces gave.
    """

    def __init__(self, rank_file: bytes, splits: dict[int, tuple[int, int]] | None = None):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.begins = self._begun()
        self.later: dict[bytes, dict] = {}
        self.stand_ins = 0
        self.fits: dict[int, bool] = {}
        self.fits_before: dict[int, bool] = {}
        self.splits = self.merges() if splits is None else splits
        self.unmade = {rank for rank, size in self.sizes.items() if size > 1 and rank not in self.splits}
        self.outputs: dict[str, tuple[int, ...]] = {}
        self.outputs_before: dict[str, tuple[int, ...]] = {}
        self.numbers = {rank: str(rank) for rank in self.tokens}
        self.shapes: dict[bytes, tuple] = {}
        self.states: dict[tuple, dict] = {}
        self._start_anew()

    def __del__(self):
        # States refer to each other in rings: they would stay in a worker until Python's collector looks for rings.
        self._let_go(getattr(self, "states", {}))

    @staticmethod
    def _let_go(states: dict[tuple, dict]) -> None:
        for key, state in states.items():
            state.clear()
            state[None] = key  # a reader that is still in it can go on

    def _start_anew(self) -> None:
        self._let_go(self.states)
        key = (b"", (NOTHING,))
        self.start = {None: key}
        self.states = {key: self.start}

    def _begun(self) -> dict[bytes, tuple[int, ...]]:
        """Of each proper beginning of a token the tokens that begin with it, if these are FEW at most, or else nothing."""
        found: dict[bytes, tuple[int, ...]] = {}
        for token, rank in self.ranks.items():
            for n in range(1, len(token)):
                known = found.get(token[:n], (rank,))
                found[token[:n]] = known if known == (rank,) else (*known, rank) if known and len(known) < FEW else ()
        return found

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Merging by rank as defined, with ranks less than `below`: the lowest pair first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, place = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return [self.ranks[part] for part in parts]

    def merges(self) -> dict[int, tuple[int, int]]:
        """For each token of several bytes the two whose merge makes it. A token that merges never make is left out."""
        found = {}
        for token, data in self.tokens.items():
            if len(data) > 1:
                parts = self.merged(data, token)
                if len(parts) == 2:
                    found[token] = (parts[0], parts[1])
        return found

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the two, merged by rank from their bytes, stay apart.

        Undo the merges of both, the latest first. If ever the two tokens that face each other make a token of lower
        rank than the merge that was undone last, merging would have joined them across the border instead.
        """
        if left == NOTHING:
            return right not in self.unmade
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = self.fits_before.get(key)
            if known is None:
                known = self._apart(left, right)
            if len(self.fits) >= MOST_PAIRS // 2:
                self.fits_before, self.fits = self.fits, {}
            self.fits[key] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        ranks, tokens, splits = self.ranks, self.tokens, self.splits
        if left in self.unmade or right in self.unmade:
            return False
        undone = 1 << 60
        one, other = splits.get(left), splits.get(right)
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < undone:
                return False
            # Of merges of equal rank the left one came first, so the right one is undone first.
            if other is None or (one is not None and left > right):
                if one is None:
                    return True
                undone, left = left, one[1]
                one = splits.get(left)
            else:
                undone, right = right + 1, other[0]
                other = splits.get(right)

    def _grow(self, state: dict, byte: int) -> tuple[dict, int]:
        """The transition of a state for a byte: the next state, and the last token after the byte."""
        suffix, lasts = state[None]
        read = suffix + bytes((byte,))
        ends, later = self.shapes.get(read) or self._shape(read)
        for place, token in ends:
            if lasts[place] != CLOSED and self.pair_fits(lasts[place], token):
                break
        else:
            raise ValueError(f"the ranks hold no token for {read[-1:]!r}")
        start, kept = len(read), []
        for place, (last, few) in enumerate(zip(lasts, later)):
            if few and last != CLOSED:
                last = few.get(last) or self._alike(last, few)
            elif few is None:
                last = CLOSED
            if kept:
                kept.append(last)
            elif last != CLOSED:
                start = place
                kept.append(last)
        key = (read[start:], (*kept, token))
        if len(self.states) >= MOST_STATES:
            self._start_anew()
        to = self.states.setdefault(key, {None: key})
        state[byte] = (to, token)
        return to, token

    def _shape(self, read: bytes) -> tuple:
        """(places and tokens from there to the end of `read`, what can go on from each place: None if nothing can, else the
        last tokens that stand for others there, with the few tokens in question under None, or nothing if they are many)."""
        if len(self.shapes) >= MOST_SHAPES or self.stand_ins >= MOST_PAIRS:
            self.shapes, self.later, self.stand_ins = {}, {}, 0
        ends = tuple((i, token) for i in range(len(read)) if (token := self.ranks.get(read[i:])) is not None)
        later = []
        for i in range(len(read)):
            few = self.begins.get(read[i:])
            later.append(few if few is None or not few else self.later.setdefault(read[i:], {None: few}))
        shape = self.shapes[read] = (ends, later)
        return shape

    def _alike(self, last: int, few: dict) -> int:
        """The last token that stands for `last` where the tokens few[None] can go on."""
        fit = tuple([token for token in few[None] if self.pair_fits(last, token)])
        self.stand_ins += 1
        few[last] = found = few.setdefault(fit, last) if fit else CLOSED
        return found

    def feed(self, data: bytes, at_once: int = 1024):
        """Token ids of one piece; of a long one those that no later byte can change, after every `at_once` bytes."""
        state, lasts, sizes = self.start, [], self.sizes
        for n, byte in enumerate(data, 1):
            step = state.get(byte)
            state, token = step if step is not None else self._grow(state, byte)
            lasts.append(token)
            if n % at_once == 0:
                paths = set(range(len(lasts) - len(state[None][0]), len(lasts) + 1))
                while len(paths) > 1:
                    furthest = max(paths)
                    paths.remove(furthest)
                    paths.add(furthest - sizes[lasts[furthest - 1]])
                agreed = paths.pop()
                yield from self._back(lasts, agreed)
                del lasts[:agreed]
        yield from self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        found, sizes = [], self.sizes
        while end > 0:
            token = lasts[end - 1]
            found.append(token)
            end -= sizes[token]
        return found[::-1]

    def short(self, data: bytes) -> list[int]:
        """Token ids of a piece that is read as a whole: `feed` without writing on the way."""
        state, lasts = self.start, []
        for byte in data:
            step = state.get(byte)
            state, token = step if step is not None else self._grow(state, byte)
            lasts.append(token)
        return self._back(lasts, len(lasts))

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern. A piece that is a token is that token."""
        output = self.outputs_before.get(text)
        if output is None:
            data = text.encode()
            whole = self.ranks.get(data)
            if len(data) > LONGEST_PIECE:
                return tuple(self.feed(data)) if whole is None else (whole,)
            output = tuple(self.short(data)) if whole is None else (whole,)
        if len(self.outputs) >= MOST_PIECES // 2:
            self.outputs_before, self.outputs = self.outputs, {}
        self.outputs[text] = output
        return output


class Decoder:
    """Bytes and text from ids as they come; a character cut between tokens waits for the rest."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def text(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def pieces(matches, text: str, at_once: int = 4096, long: int = 1 << 20):
    """All matches in lists; of a long text only `at_once` are held at a time."""
    if len(text) < long:
        yield matches.findall(text)
        return
    found = matches.finditer(text)
    while some := [match.group() for match in itertools.islice(found, at_once)]:
        yield some


def encode_documents(docs: DataFrame, rank_file: bytes, split: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `keep_ids`, the ids themselves, a row per row of `docs`.

    Each match of `split` is encoded separately, special tokens are plain text. `ids_sha256` is of the decimal ids joined
    by one space, `decoded_sha256` of the bytes that the ids decode to. Null and empty texts have no tokens and the
    digests of nothing. Rows are independent: nothing is shuffled, repeated rows give repeated results.
    The rank file and the merges behind its tokens (about 2 MB, a fixed size) go to the workers.
    """
    split = split or pattern()
    # What the merges of each token are is worked out once, here. The value stays in a worker from task to task, and
    # so does the machine that the first task puts into it.
    held = docs.sparkSession.sparkContext.broadcast({"ranks": rank_file, "splits": Transducer(rank_file).splits})

    def encode(batches):
        import regex

        shared, matches = held.value, regex.compile(split)
        machine = shared.get("machine") or shared.setdefault("machine", Transducer(shared["ranks"], shared["splits"]))
        numbers = machine.numbers.__getitem__
        for batch in batches:
            rows, ids, first = [], array("i"), 0
            for place, text in enumerate(batch.column("text")):
                ids_hash, bytes_hash, n, space = hashlib.sha256(), hashlib.sha256(), 0, ""
                decoder = Decoder(machine.tokens)
                for some in pieces(matches, text.as_py() or ""):
                    known = machine.outputs
                    found = [i for piece in some for i in known.get(piece) or machine.piece(piece)]
                    if not found:
                        continue
                    ids_hash.update((space + " ".join(map(numbers, found))).encode())
                    space = " "
                    n += len(found)
                    # Through the decoder's state machine: what reaches the digest are whole characters.
                    bytes_hash.update(decoder.text(decoder.feed(found)).encode())
                    if keep_ids:
                        ids.extend(found)
                bytes_hash.update(decoder.finish().encode())
                rows.append((n, ids_hash.hexdigest(), bytes_hash.hexdigest()))
                if len(ids) >= IDS_OUT:
                    yield out(batch, first, rows, ids)
                    rows, ids, first = [], array("i"), place + 1
            if rows:
                yield out(batch, first, rows, ids)

    def out(batch, first, rows, ids):
        columns = [batch.column("doc_id").slice(first, len(rows)), *(pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS))]
        if keep_ids:
            ends = list(itertools.accumulate((row[0] for row in rows), initial=0))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(tidy(encode), schema + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, rank_file: bytes, at_once: int = 4096) -> DataFrame:
    """doc_id and text from doc_id and ids; the inverse of encoding. Null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def decode(batches):
        tokens = Transducer(held.value, {}).tokens
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder, ids = Decoder(tokens), ids.as_py() or []
                texts.append("".join(decoder.text(decoder.feed(ids[i : i + at_once])) for i in range(0, len(ids), at_once)) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(decode), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
