"""SentencePiece encoding and decoding with a byte-pair model, word by word over a shared-prefix trie.

Marked text (every space a ``▁``, one in front) is cut where no piece of the vocabulary crosses: before a
run of ``▁`` and before punctuation that no piece has behind a letter.  Distinct words are sorted, which
lays them out as a trie in depth-first order; going from one word to the next keeps the forward states of
the common prefix and computes only the rest.  Words over ``SHARED`` characters go by themselves, with one number
kept for each prefix, so memory is linear in a word.  Each worker remembers the words it has met, up to a bound
in bytes.

The forward state is what the named method's best score is for a unigram model.  The given model is a
byte-pair model, whose result is not the best sum of scores, so a plain Viterbi search would be wrong.
But a segmentation is the byte-pair result if and only if each two neighbouring pieces, merged on their
own, stay these two pieces.  So every prefix of a word has exactly one last piece whose left neighbour
(the last piece of the shorter prefix) is valid, and the search over last pieces is a Viterbi recursion
with the scores "valid" and "not valid".  The pair test runs the merges on two pieces and is remembered.

Characters outside the vocabulary become byte pieces.  The library is used to read the model file only.

Defined results: a null text gives null ids and decodes to null, an empty text gives no ids; decoding
turns ``▁`` of the original into a space, as the library does, and each byte that is no UTF-8 into U+FFFD;
ids outside the vocabulary fail the task; repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import codecs
import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.llm.batches import texts

MARK = "▁"
KEPT_BYTES, KEPT_PAIRS = 150_000_000, 400_000  # a worker's memories (some 600,000 words); each is emptied when full
SHARED = 64  # characters up to which words share encodings along the trie
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        from sentencepiece import SentencePieceProcessor

        source = SentencePieceProcessor(model_file=path)
        names = [source.id_to_piece(i) for i in range(len(source))]
        special = [source.is_control(i) or source.is_unused(i) for i in range(len(source))]
        self.bytes_id = {int(n[3:5], 16): i for i, n in enumerate(names) if source.is_byte(i)}
        self.ids, self.scores, self.outputs = {}, {}, []
        for i, name in enumerate(names):
            if source.is_byte(i):
                self.outputs.append(bytes([int(name[3:5], 16)]))
            elif special[i]:
                self.outputs.append(b"")
            elif source.is_unknown(i):
                self.outputs.append(" ⁇ ".encode())
            else:
                self.ids[name], self.scores[name] = i, source.get_score(i)
                self.outputs.append(name.replace(MARK, " ").encode())
        self.marked = [n.startswith(MARK) and n in self.ids for n in names]
        self.reach: dict[str, int] = {}  # length of the longest piece by its last three characters
        for name in self.ids:
            self.reach[name[-3:]] = max(self.reach.get(name[-3:], 2), len(name))
        self.unknown = source.unk_id()
        self.kind = np.dtype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
        self.splitter = self._splitter()
        self.words: dict[str, bytes] = {}
        self.held, self.kept_bytes = 0, kept_bytes  # bytes of these
        self.pairs: dict[tuple[str, str], bool] = {}
        self.codes: dict[str, bytes] = {}

    def _splitter(self) -> re.Pattern:
        """Words end where no piece crosses; worked out from the whole vocabulary.

        That is before marks, around characters that no longer piece has, and between a letter or digit
        and punctuation unless the letter is one of the few that pieces have before punctuation.
        """
        inner = {(p[i - 1], p[i]) for p in self.ids for i in range(1, len(p))}
        if any(b == MARK and a != MARK for a, b in inner):
            raise ValueError("the vocabulary has pieces across words")
        joined = {c for pair in inner for c in pair}
        alone = set("\n\t\r") - joined
        before = {p: {a for a, b in inner if b == p and a.isalnum()} for p in set(string.punctuation) - {"_"}}
        cut = {p for p, letters in before.items() if len(letters) <= 2}
        odd = set().union(*(before[p] for p in cut)) if cut else set()
        lone, c, x = (re.escape("".join(sorted(s))) for s in (alone or {"\n"}, cut or {","}, odd))
        if not alone or not cut:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        inside = f"[^{MARK}{c}{lone}]"
        return re.compile(f"[{lone}]|(?:{MARK}+[{c}]?|[{c}]|{inside})(?:{inside}+|(?<![^\\W_{x}])[{c}])*")

    def split(self, text: str) -> list[str]:
        return self.splitter.findall(MARK + text.replace(" ", MARK)) if text else []

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, of equal ones the leftmost."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def valid(self, left: str, right: str) -> bool:
        """Whether two pieces stay what they are when merged on their own."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return fits

    def _code(self, piece: str) -> bytes:
        """The ids of a piece or of a character outside the vocabulary, as raw numbers."""
        known = self.ids.get(piece)
        if known is not None:
            ids = [known]
        elif self.bytes_id:
            ids = [self.bytes_id[b] for b in piece.encode()]
        else:
            ids = [self.unknown]
        return np.array(ids, self.kind).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode distinct words: the long ones each by itself, the others in depth-first order of their trie."""
        for word in words:
            if len(word) > SHARED:
                self.words[word] = self.encode_long(word)
        last: list[str] = []  # of each prefix of the current path: its last piece,
        coded: list[bytes] = []  # and the ids of all its pieces
        path, known, pairs, reach, codes = "", self.ids, self.pairs, self.reach, self.codes
        for word in sorted(w for w in words if len(w) <= SHARED):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared:], coded[shared:]
            for end in range(shared + 1, len(word) + 1):
                size = reach.get(word[end - 3 if end > 3 else 0 : end], 2)  # shorter ones are tried anyhow
                for begin in range(end - size if end > size else 0, end):
                    piece = word[begin:end]
                    if piece in known or end - begin == 1:
                        if not begin:
                            break
                        left = last[begin - 1]
                        fits = pairs.get((left, piece))
                        if fits or (fits is None and self.valid(left, piece)):
                            break
                code = codes.get(piece)
                if code is None:
                    code = codes[piece] = self._code(piece)
                last.append(piece)
                coded.append(coded[begin - 1] + code if begin else code)
            path = word
            self.words[word] = coded[-1]
        self.held += sum(200 + 4 * len(w) + len(self.words[w]) for w in words)

    def encode_long(self, word: str) -> bytes:
        """The ids of a word of any length: a number for each prefix, the size of its last piece, traced back."""
        sizes, known, pairs, reach = array("I"), self.ids, self.pairs, self.reach
        for end in range(1, len(word) + 1):
            size = reach.get(word[end - 3 if end > 3 else 0 : end], 2)
            for begin in range(end - size if end > size else 0, end):
                piece = word[begin:end]
                if piece in known or end - begin == 1:
                    if not begin:
                        break
                    left = word[begin - sizes[begin - 1] : begin]
                    fits = pairs.get((left, piece))
                    if fits or (fits is None and self.valid(left, piece)):
                        break
            sizes.append(end - begin)
        found, at = [], len(word)
        while at:
            piece = word[at - sizes[at - 1] : at]
            code = self.codes.get(piece)
            if code is None:
                code = self.codes[piece] = self._code(piece)
            found.append(code)
            at -= len(piece)
        return b"".join(reversed(found))

    def encode(self, many: list[str]) -> list[np.ndarray]:
        if self.held > self.kept_bytes:
            self.words.clear()
            self.held = 0
        split = [self.split(t) for t in many]
        self.learn(list(set().union(*split) - self.words.keys()))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, s)), self.kind) for s in split]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.outputs.__getitem__, ids))
        if ids and self.marked[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def load_model(path: str, kept_bytes: int = KEPT_BYTES) -> PieceModel:
    return PieceModel(path, kept_bytes)


def encode_pieces(text: Column | str, model_path: str, kept_bytes: int = KEPT_BYTES) -> Column:
    """The ids of a text.

    A worker lives on between tasks and remembers its words, up to ``kept_bytes``; other stages of a job lack that memory.
    """

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        return _ids_array(load_model(model_path, kept_bytes).encode(texts(column)), column.is_null())

    return encode(text)


def _ids_array(found: list[np.ndarray], missing: pa.Array) -> pa.Array:
    lengths = np.array([len(f) for f in found], np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)


def decode_pieces(ids: Column | str, model_path: str, kept_bytes: int = KEPT_BYTES) -> Column:
    """The text of ids; with the ``kept_bytes`` of ``encode_pieces`` both share one model."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        model, values, ends = load_model(model_path, kept_bytes), column.values.to_numpy(), column.offsets.to_numpy().tolist()
        missing = column.is_null().to_pylist()
        rows = zip(missing, ends[:-1], ends[1:], strict=True)
        return pa.array([None if gone else model.decode(values[a:b].tolist()) for gone, a, b in rows], pa.string())

    return decode(ids)


def encode_and_decode(text: Column | str, model_path: str, kept_bytes: int = KEPT_BYTES) -> Column:
    """A struct of the ``ids`` of a text and what they decode to, ``decoded``.

    Spark works ``decode_pieces`` of a column of ``encode_pieces`` out as one chain beside that column, so that
    every text is encoded twice; here it is encoded once.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def both(column: pa.Array) -> pa.Array:
        model, missing = load_model(model_path, kept_bytes), column.is_null()
        found = model.encode(texts(column))
        rows = zip(found, missing.to_pylist(), strict=True)
        decoded = pa.array([None if gone else model.decode(ids.tolist()) for ids, gone in rows], pa.string())
        return pa.StructArray.from_arrays([_ids_array(found, missing), decoded], ["ids", "decoded"])

    return both(text)
