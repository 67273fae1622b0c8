"""SentencePiece encoding and decoding with a table of each prefix's last token.

The tokens of a text are those of merging its characters by score, the leftmost of equals first. Merges never cross the
border of two tokens of the result, so the tokens of a prefix that ends there are the tokens before it; and a row of
tokens is the right one exactly if each neighbouring pair, merged by itself, stays two tokens. Every prefix of a text
therefore has one last token: of the pieces that end there the one that fits the last token at its own start. An
automaton finds the pieces, `fits` tests the pair, and the ids are read backwards from the end of the table.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import os
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a worker's two memories; the older half of each goes when it is full. Together they take about 120 MB.
MOST_SEGMENTS = 300_000
MOST_PAIRS = 400_000
#: Longest segment, in characters, whose ids are remembered; a text of so many is long; segments of it looked at in one go.
LONGEST_SEGMENT = 40
LONG_TEXT = 1 << 18
AT_ONCE = 4096
#: Ids after which a record batch goes out.
IDS_OUT = 1 << 18

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SURFACE = " ⁇ "


def read_model(name_or_path: str) -> dict:
    """Pieces, scores and kinds of a model file: of the installed public tokenizers by name, or any by path.

    Merge models with byte fallback whose texts are only prefixed with a space are understood, others raise ValueError.
    """
    from sentencepiece import sentencepiece_model_pb2

    if os.sep not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    trained, normal = model.trainer_spec, model.normalizer_spec
    kinds = [piece.type for piece in model.pieces]
    plain = not (normal.precompiled_charsmap or normal.remove_extra_whitespaces or trained.treat_whitespace_as_suffix)
    if trained.model_type != trained.BPE or not (trained.byte_fallback and normal.add_dummy_prefix and plain):
        raise ValueError(f"{name_or_path}: only merge models with byte fallback, a leading space and no other normalisation")
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{name_or_path}: pieces defined by users, or unused ones")
    return {"pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "kinds": kinds}


class Pieces:
    """The pieces of a model: their ranks, the two parts that make each, and their bytes.

    A character that is no piece stands as the negative number -2 - its code point.
    """

    def __init__(self, model: dict, parts: dict[int, tuple[int, int]] | None = None):
        self.names, kinds = model["pieces"], model["kinds"]
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, kinds)) if kind == NORMAL}
        order = {score: rank for rank, score in enumerate(sorted({model["scores"][i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {i: order[model["scores"][i]] for i in self.ids.values()}
        self.byte_ids = {int(name[1:-1], 16): i for i, (name, kind) in enumerate(zip(self.names, kinds)) if kind == BYTE}
        self.surfaces = [self._surface(name, kind) for name, kind in zip(self.names, kinds)]
        self.parts = self._made() if parts is None else parts
        # Where pieces share a score, or a part's merge comes after the whole's, the order of merges is more than rank.
        count: dict[int, int] = {}
        for i in self.parts:
            count[self.ranks[i]] = count.get(self.ranks[i], 0) + 1
        self.odd = {i for i in self.parts if count[self.ranks[i]] > 1}
        for whole in sorted(self.parts, key=lambda i: len(self.names[i])):
            if any(p in self.odd or (p in self.parts and self.ranks[p] >= self.ranks[whole]) for p in self.parts[whole]):
                self.odd.add(whole)

    @staticmethod
    def _surface(name: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes((int(name[1:-1], 16),))
        if kind == CONTROL:
            return b""
        return UNKNOWN_SURFACE.encode() if kind == UNKNOWN else name.replace(SPACE, " ").encode()

    def symbol(self, character: str) -> int:
        return self.ids.get(character, -2 - ord(character))

    def name(self, symbol: int) -> str:
        return self.names[symbol] if symbol >= 0 else chr(-2 - symbol)

    def merged(self, text: str) -> list[tuple[str, int, int]]:
        """Merging as defined: (name, left part, right part) of each token, parts being symbols, -1 if there are none."""
        row = [(c, -1, -1) for c in text]
        while len(row) > 1:
            best, place = None, -1
            for i in range(len(row) - 1):
                found = self.ids.get(row[i][0] + row[i + 1][0])
                if found is not None and (best is None or self.ranks[found] < best):
                    best, place = self.ranks[found], i
            if best is None:
                break
            left, right = row[place][0], row[place + 1][0]
            part = [self.ids[x] if x in self.ids else -2 - ord(x) for x in (left, right)]
            row[place : place + 2] = [(left + right, *part)]
        return row

    def _made(self) -> dict[int, tuple[int, int]]:
        """For each piece of several characters the two whose merge makes it; one that merges never make is left out."""
        found = {}
        for name, i in self.ids.items():
            if len(name) > 1:
                row = self.merged(name)
                if len(row) == 1:
                    found[i] = row[0][1:]
        return found

    def encode_as_defined(self, text: str) -> list[int]:
        """Ids by merging step by step; for tests and short texts."""
        found = []
        for name, _, _ in self.merged(SPACE + text.replace(" ", SPACE) if text else ""):
            found += [self.ids[name]] if name in self.ids else [self.byte_ids[b] for b in name.encode()]
        return found


class PrefixTable:
    """Ids of texts from the last token of each prefix.

    Texts are cut first where no piece can cover the border: before a space that follows something else, if no piece has
    one inside, and around characters that only stand alone. The ids of short segments are remembered.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.made = {name: i for name, i in pieces.ids.items() if len(name) == 1 or i in pieces.parts}
        self.sizes = {i: len(name) for name, i in self.made.items()}
        self.begins = {name[:n] for name in self.made for n in range(1, len(name) + 1)}
        self.states: dict[str, dict] = {"": {None: ""}}
        long = [name for name in pieces.ids if len(name) > 1]
        joining = "".join(sorted({re.escape(c) for name in long for c in name if c != SPACE}))
        inside = any(SPACE in name.lstrip(SPACE) for name in long)
        joined = f"[{joining}{SPACE}]+" if inside else f"{SPACE}*[{joining}]+|{SPACE}+"
        self.cuts = re.compile(f"{joined}|[^{joining}{SPACE}]" if joining else f"{SPACE}+|[^{SPACE}]")
        self.shift, self.numbers = len(pieces.names).bit_length(), [str(i) for i in range(len(pieces.names))]
        # Two generations of each memory: what is used again outlives a full one.
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.before: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.pairs: dict[int, bool] = {}
        self.pairs_before: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged from their characters, stay apart."""
        key = (left << self.shift) + right
        known = self.pairs_before.get(key)
        if known is None:
            odd = self.pieces.odd
            known = self._merged_apart(left, right) if left in odd or right in odd else self._apart(left, right)
        if len(self.pairs) >= MOST_PAIRS // 2:
            self.pairs_before, self.pairs = self.pairs, {}
        self.pairs[key] = known
        return known

    def _merged_apart(self, left: int, right: int) -> bool:
        one, other = self.pieces.name(left), self.pieces.name(right)
        return [row[0] for row in self.pieces.merged(one + other)] == [one, other]

    def _apart(self, left: int, right: int) -> bool:
        """From the last merge back to the first: whenever the two that face each other have a merge of their own that
        comes before the one just taken back, it would have joined them."""
        ids, ranks, parts, name = self.pieces.ids, self.pieces.ranks, self.pieces.parts, self.pieces.name
        bound, one, other = 1 << 60, parts.get(left), parts.get(right)
        while True:
            joined = ids.get(name(left) + name(right))
            if joined is not None and ranks[joined] < bound:
                return False
            if one is None and other is None:
                return True
            # Of equal merges the left one comes first, so the right one is taken back first.
            if other is None or (one is not None and ranks[left] > ranks[right]):
                bound, left = ranks[left], one[1]
                one = parts.get(left)
            else:
                bound, right = ranks[right] + 1, other[0]
                other = parts.get(right)

    def grow(self, state: dict, character: str) -> tuple[dict, tuple[tuple[int, int], ...]]:
        """The automaton's step from a state for a character: the next state, and (token, size) of all pieces that end
        here, the longest first. A state is the longest end of what was read that a piece begins with; states and steps are
        made when first needed, and there are no more of them than pieces have beginnings."""
        read = state[None] + character
        found = tuple((self.made[read[i:]], len(read) - i) for i in range(len(read)) if read[i:] in self.made)
        while read and read not in self.begins:
            read = read[1:]
        step = (self.states.setdefault(read, {None: read}), found)
        if character in self.begins:
            state[character] = step
        return step

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix of `text`, spaces written as pieces have them; a pointer a character."""
        last, grow, fits, pairs, shift, state = [], self.grow, self.fits, self.pairs, self.shift, self.states[""]
        for end, character in enumerate(text):
            state, found = state.get(character) or grow(state, character)
            for token, size in found:
                if end < size:
                    break
                left = last[end - size]
                apart = pairs.get((left << shift) + token)
                if apart is None:
                    apart, pairs = fits(left, token), self.pairs
                if apart:
                    break
            else:
                token = -2 - ord(character)
            last.append(token)
        return last

    def backwards(self, last: list[int]) -> list[int]:
        found, sizes, byte_ids = [], self.sizes, self.pieces.byte_ids
        at = len(last) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                found.append(token)
                at -= sizes[token]
            else:
                found += [byte_ids[b] for b in reversed(chr(-2 - token).encode())]
                at -= 1
        found.reverse()
        return found

    def segment(self, text: str) -> tuple[str, tuple[int, ...]]:
        """(decimal ids joined by commas, ids) of a segment."""
        output = self.before.get(text)
        if output is None:
            whole = self.made.get(text)  # a piece that merges make is its own token
            ids = tuple(self.backwards(self.last_tokens(text))) if whole is None else (whole,)
            output = (",".join([self.numbers[i] for i in ids]), ids)
        if len(text) <= LONGEST_SEGMENT:
            if len(self.known) >= MOST_SEGMENTS // 2:
                self.before, self.known = self.known, {}
            self.known[text] = output
        return output

    def outputs(self, text: str):
        """Lists of the outputs of a text's segments; of a long text AT_ONCE of them at a time."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        if len(text) < LONG_TEXT:
            known = self.known.get
            yield [known(x) or self.segment(x) for x in self.cuts.findall(text)]
            return
        found = self.cuts.finditer(text)
        while some := [match.group() for match in itertools.islice(found, AT_ONCE)]:
            yield [self.known.get(x) or self.segment(x) for x in some]

    def encode(self, text: str) -> list[int]:
        return [i for some in self.outputs(text) for output in some for i in output[1]]


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("shelltrail-each-byte", _each_byte)


class PieceDecoder:
    """Text from ids as they come: the leading space goes, bytes wait until their character is whole.

    Each byte that belongs to no character becomes U+FFFD.
    """

    def __init__(self, surfaces: list[bytes], is_byte: list[bool]):
        # Registered where the decoder is made, too: a function sent to a worker does not run its module there.
        codecs.register_error("shelltrail-each-byte", _each_byte)
        self.surfaces, self.is_byte = surfaces, is_byte
        self.machine = codecs.getincrementaldecoder("utf-8")("shelltrail-each-byte")
        self.leading = True

    def _begin(self, ids) -> tuple[bytes, int]:
        """Ids up to the first that writes anything or has the leading space."""
        for n, i in enumerate(ids):
            data = self.surfaces[i]
            if self.is_byte[i]:
                self.leading = False
                return data, n + 1
            if data:
                self.leading = False
                return data[1:] if data[:1] == b" " and data != UNKNOWN_SURFACE.encode() else data, n + 1
        return b"", len(ids)

    def text(self, ids) -> str:
        data = b""
        if self.leading:
            data, begun = self._begin(ids)
            ids = ids[begun:]
        return self.machine.decode(data + b"".join(map(self.surfaces.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


COLUMNS = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))


def encode_documents(docs: DataFrame, model: dict, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `keep_ids`, the ids themselves, a row per row of `docs`.

    Ids are the sentencepiece library's for `model` (see `read_model`), without begin or end; `ids_sha256` is of the decimal
    ids joined by commas, `decoded_sha256` of the UTF-8 text that the ids decode to. Strings like `<s>` are plain text.
    Null and empty texts have no tokens and the digests of nothing. A U+2581 in a text decodes to a space, as it does in the
    library. Rows are independent: nothing is shuffled, repeated rows give repeated results, null ids stay, other columns
    are not read. A very long text costs 8 bytes a character between two cuts besides itself.
    The model and the parts of its pieces (a few MB, a fixed size) go to the workers.
    """
    held = docs.sparkSession.sparkContext.broadcast({"model": model, "parts": Pieces(model).parts})

    def encode(batches):
        shared = held.value
        table = shared.get("table") or shared.setdefault("table", PrefixTable(Pieces(shared["model"], shared["parts"])))
        surfaces, is_byte = table.pieces.surfaces, [kind == BYTE for kind in shared["model"]["kinds"]]
        for batch in batches:
            rows, ids, first = [], array("i"), 0
            for place, text in enumerate(batch.column("text")):
                ids_hash, text_hash, n, comma = hashlib.sha256(), hashlib.sha256(), 0, ""
                decoder = PieceDecoder(surfaces, is_byte)
                for outputs in table.outputs(text.as_py() or ""):
                    ids_hash.update((comma + ",".join([x[0] for x in outputs])).encode())
                    comma = ","
                    found = [i for x in outputs for i in x[1]]
                    n += len(found)
                    text_hash.update(decoder.text(found).encode())
                    if keep_ids:
                        ids.extend(found)
                text_hash.update(decoder.finish().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
                if len(ids) >= IDS_OUT:
                    yield out(batch, first, place + 1, rows, ids)
                    rows, ids, first = [], array("i"), place + 1
            if rows:
                yield out(batch, first, batch.num_rows, rows, ids)

    def out(batch, first, last, rows, ids):
        columns = [batch.column("doc_id").slice(first, last - first), *(pa.array(c, kind) for c, kind in zip(zip(*rows), COLUMNS))]
        if keep_ids:
            ends = list(itertools.accumulate((row[0] for row in rows), initial=0))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, model: dict, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id and text from doc_id and ids, as the library decodes them. Null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        model = held.value
        surfaces = [Pieces._surface(name, kind) for name, kind in zip(model["pieces"], model["kinds"])]
        is_byte = [kind == BYTE for kind in model["kinds"]]
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder, ids = PieceDecoder(surfaces, is_byte), ids.as_py() or []
                texts.append("".join(decoder.text(ids[i : i + at_once]) for i in range(0, len(ids), at_once)) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
