"""Token ids of whole texts by public tokenizer files, as packed little-endian uint32.

A text is cut where no pre-token can cross, and each piece's ids are looked up in a bounded
cache of the worker; the library computes what the cache lacks.  The result equals one library
call on the whole text, at a fraction of its cost, because pieces repeat.
"""

from __future__ import annotations

import base64
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tacit.llm.text import once

# A space before anything but white space starts a new pre-token in the byte-level pattern,
# whatever stands before it, and what it cuts off is split the same way alone.
_BYTE_CUT = regex.compile(r" (?=\S)")
# Spaces that may not be such cuts, by the widest notion of white space.
_ODD_SPACE = r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|$)"
# Fixed value: the pre-token pattern of byte-level files, as they state it.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pieces that a worker remembers, twice over.
PIECES = 400_000
# Bytes of text encoded at a time: the longer, the fewer pieces are looked up.
ENCODE_BYTES = 16 << 20


def byte_pieces(texts: pa.Array) -> pa.Array:
    """Lists of pieces, cut at each space that a character other than white space follows.

    Every piece but the first of a text stands for itself with a space before it.
    """
    lists = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
    if not odd.any():
        return lists
    slow = pa.array([_BYTE_CUT.split(text) for text in texts.filter(pa.array(odd)).to_pylist()])
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(int(odd.sum()))
    return pa.concat_arrays([lists, slow.cast(lists.type)]).take(pa.array(order))


# Kinds of bytes: what no cut may touch, letters, digits, white space, other printable ASCII, and
# first bytes of Latin letters, until the next byte tells.
ODD, LETTER, DIGIT, WHITE, MARK, LEAD = range(6)


def _kinds() -> np.ndarray:
    table = np.full(256, ODD, np.uint8)
    for code in range(0x21, 0x7F):
        one = chr(code)
        table[code] = LETTER if one.isalpha() else DIGIT if one.isdigit() else MARK
    table[[ord(one) for one in " \n\t\r"]] = WHITE
    table[0xC3:0xCA] = LEAD
    return table


_KINDS = _kinds()
_LOWER = np.array([code + 32 if 65 <= code <= 90 else code for code in range(256)], np.uint8)


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; Latin letters up to U+024F have two bytes of their kind."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(kinds == LEAD)
    if len(lead):
        code = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        # Two signs, and a letter whose lower case is a letter and a mark.
        letter = (code != 0xD7) & (code != 0xF7) & (code != 0x130)
        kinds[lead] = kinds[lead + 1] = np.where(letter, LETTER, ODD)
    return kinds


def _meetings(also) -> np.ndarray:
    """Per two kinds in a row, whether a cut lies between them; ``also`` adds some."""
    cuts = np.zeros((5, 5), bool)
    for left in (LETTER, DIGIT, MARK):
        for right in (LETTER, DIGIT, MARK):
            cuts[left, right] = left != right
    for pair in also:
        cuts[pair] = True
    return cuts.ravel()


_WORD_CUTS = _meetings([(DIGIT, DIGIT)] + [p for k in range(5) for p in ((k, WHITE), (WHITE, k))])
_BYTE_CUTS = _meetings([(LETTER, WHITE), (DIGIT, WHITE), (MARK, WHITE)])


def _cuts(data: np.ndarray, kinds: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    cut = np.empty(len(data), bool)
    cut[1:] = table[kinds[:-1] * np.uint8(5) + kinds[1:]]
    # An apostrophe may take letters with it.
    after = np.flatnonzero(data[:-1] == ord("'")) + 1
    cut[after] &= kinds[after] != LETTER
    cut[starts] = True
    return cut


def word_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin and where white space lies, for tokenizers that drop it.

    Those also take digits one by one.  ``starts`` are the texts' first bytes, of which none is 0.
    """
    kinds = byte_kinds(data)
    cut = _cuts(data, kinds, starts, _WORD_CUTS)
    white = kinds == WHITE
    return np.flatnonzero(cut & ~white), np.flatnonzero(white)


def byte_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, None]:
    """Where pieces begin, for the byte-level pattern: a space goes with what follows it."""
    kinds = byte_kinds(data)
    cut = _cuts(data, kinds, starts, _BYTE_CUTS)
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    white = np.flatnonzero(kinds == WHITE)
    # A last byte has no next one in its text.
    white = white[~first[white + 1]]
    follows = kinds[white + 1]
    white = white[(follows != ODD) & (follows != WHITE)]
    space = data[white] == ord(" ")
    cut[white[space]] = True
    # One sign of white space, not a space, stands alone: what follows begins anew.
    alone = white[~space]
    before = kinds[np.maximum(alone, 1) - 1]
    cut[alone[first[alone] | ((before != ODD) & (before != WHITE))] + 1] = True
    return np.flatnonzero(cut), None


class Ids(dict):
    """Piece -> packed ids.  A full cache becomes the old one, from which used pieces return."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = self.make(piece)
        self.put(piece, made)
        return made

    def put(self, piece: str, made: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = made


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    return made.tobytes()


class Encoder:
    """Ids of texts; ``cut`` makes pieces and ``learn`` fills a cache with what it lacks.

    ``added`` maps strings that stand for one id each, wherever they occur, to their ids.
    """

    def __init__(self, cut, first: Ids | None, rest: Ids, learn=None, added=None):
        self.cut, self.first, self.rest, self.learn = cut, first, rest, learn
        self.added = added or {}
        # Of strings that begin at the same place the longest counts.
        longest = sorted(self.added, key=len, reverse=True)
        self.find = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and where each text's begin; null and empty have none."""
        texts = texts.fill_null("")
        odd = np.zeros(len(texts), bool)
        for string in self.added:
            odd |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._ordinary(texts)
        # What lies between added strings is encoded alone; the id of each goes behind its part.
        parts, after, counts = [], [], np.ones(len(texts), np.int64)
        for at in np.flatnonzero(odd).tolist():
            text, low = texts[at].as_py(), 0
            for hit in self.find.finditer(text):
                parts.append(text[low : hit.start()])
                after.append(self.added[hit.group()])
                low = hit.end()
                counts[at] += 1
            parts.append(text[low:])
            after.append(-1)
        split = np.repeat(odd, counts)
        order, ids_after = np.empty(len(split), np.int64), np.full(len(split), -1, np.int64)
        order[~split] = np.flatnonzero(~odd)
        order[split] = len(texts) + np.arange(len(parts))
        ids_after[split] = after
        rows = pa.concat_arrays([texts, pa.array(parts, texts.type)]).take(pa.array(order))
        ids, starts = self._ordinary(rows)
        marked = ids_after >= 0
        ids = np.insert(ids, starts[1:][marked], ids_after[marked].astype(np.uint32))
        starts = starts + np.concatenate([[0], np.cumsum(marked)])
        return ids, starts[np.concatenate([[0], np.cumsum(counts)])]

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added strings; none is null."""
        lists = self.cut(texts)
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        pieces = coded.dictionary.to_pylist()
        if self.learn:
            self.learn(self.rest, pieces)
        made = [self.rest[piece] for piece in pieces]
        if self.first is not None and len(texts):
            heads = [pieces[k] for k in at[starts[:-1]]]
            at[starts[:-1]] = len(made) + np.arange(len(heads))
            made += [self.first[piece] for piece in heads]
        taken = pa.array(made, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", ends[-1] // 4)
        return ids, ends[starts] // 4

    def encode_one(self, text: str | None) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()


class RunEncoder(Encoder):
    """Pieces are runs of bytes that ``runs`` finds; what the cache lacks is learnt at once."""

    def __init__(self, runs, known: Ids, learn, added=None):
        super().__init__(None, None, known, learn, added)
        self.runs = runs

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        starts = (ends - ends[0]).astype(np.int64)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        at, white = self.runs(data, starts[:-1][np.diff(starts) > 0])
        counts = np.searchsorted(at, starts)  # pieces before each text
        if white is not None:
            at = at - np.searchsorted(white, at)
            data = _LOWER[np.delete(data, white)]
        bounds = np.append(at, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        made = pa.array(self._looked_up(coded.dictionary), pa.large_binary())
        taken = made.take(coded.indices)
        sizes = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", sizes[-1] // 4)
        return ids, sizes[counts] // 4

    def _looked_up(self, pieces: pa.Array) -> list[bytes]:
        known = self.rest
        found = pieces.to_numpy(zero_copy_only=False).tolist()
        made = list(map(known.get, found))
        lacking = [at for at, value in enumerate(made) if value is None]
        old = known.old
        if old:
            for at in lacking:
                value = old.get(found[at])
                if value is not None:
                    made[at] = value
                    known.put(found[at], value)
            lacking = [at for at in lacking if made[at] is None]
        if lacking:
            for at, value in zip(lacking, self.learn(pieces.take(pa.array(lacking)))):
                made[at] = value
                known.put(found[at], value)
        return made


# Longest piece that is learnt with others, and how many are in one library call.
LEARN_BYTES, LEARN_PIECES = 64, 10_000
_LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


def _library(path: str, word: bool):
    """``learn`` for a file of the tokenizers library: the packed ids of each of an array of pieces.

    Pieces that are one pre-token of letters go through the library together: with ends of words
    their ids part behind each end, else where their bytes do.  Others go one by one.  Added
    tokens are ordinary text here.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    # What an id adds: an end of a word, or bytes.
    adds = np.zeros(max(vocabulary.values()) + 1, np.int64)
    suffix = tokenizer.model.end_of_word_suffix
    for token, code in vocabulary.items():
        adds[code] = token.endswith(suffix) if word else len(token)

    def call(text: str) -> np.ndarray:
        made = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(made.ids, np.uint32)

    def together(pieces: pa.Array) -> list[bytes]:
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        if word:
            ids, ends = call(" ".join(texts)), np.arange(1, len(texts) + 1)
            skip = np.zeros(len(texts), np.int64)
        else:
            # A piece without a space of its own follows a line end, which is one id.
            skip = (~pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = call("".join([piece if piece[0] == " " else "\n" + piece for piece in texts]))
            ends = np.cumsum(pc.binary_length(pieces).to_numpy() + skip)
        done = np.cumsum(adds[ids])
        if not len(ids) or done[-1] != ends[-1]:
            return [call(text).tobytes() for text in texts]
        high = np.searchsorted(done, ends) + 1
        low = np.append(0, high[:-1]) + skip
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip((4 * low).tolist(), (4 * high).tolist())]

    def learn(pieces: pa.Array) -> list[bytes]:
        letters = pc.and_(
            pc.match_substring_regex(pieces, _LETTERS), pc.less_equal(pc.binary_length(pieces), LEARN_BYTES)
        ).to_numpy(zero_copy_only=False)
        made: list = [None] * len(pieces)
        for at in np.flatnonzero(~letters).tolist():
            made[at] = call(pieces[at].as_py()).tobytes()
        every = np.flatnonzero(letters)
        for low in range(0, len(every), LEARN_PIECES):
            some = every[low : low + LEARN_PIECES]
            for at, value in zip(some.tolist(), together(pieces.take(pa.array(some)))):
                made[at] = value
        return made

    return learn


def read_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file with their ids."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if any(token[name] for name in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} does not stand for itself alone")
    return {token["content"]: token["id"] for token in added}


def library_encoder(path: str, kind: str, added: bool = False) -> Encoder:
    """The worker's encoder for a tokenizers file; ``kind`` is "byte" or "word".

    With ``added``, strings in a text that are added tokens of the file get their ids, as in the
    library's own call; without, they are ordinary text (its ``encode_special_tokens``).
    """
    word = kind == "word"

    def make():
        strings = read_added(path) if added else None
        known = Ids(None, PIECES // 8 if word else PIECES // 2)
        return RunEncoder(word_runs if word else byte_runs, known, _library(path, word), strings)

    return once(("tokens", "library", path, kind, added), make)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file: base64 and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoder(path: str, pattern: str = BYTE_PATTERN) -> Encoder:
    """The worker's encoder for a rank file, without special tokens."""

    def make():
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        widths[list(ranks.values())] = [len(token) for token in ranks]

        def learn(known: Ids, pieces: list[str]) -> None:
            """Encode all new pieces in one call; their ids part where their bytes do."""
            new = [piece for piece in pieces if piece not in known and piece not in known.old]
            ids = np.array(encoding.encode_ordinary("".join([" " + piece for piece in new])), "<u4")
            ends = np.cumsum([1 + len(piece.encode()) for piece in new])
            cuts = np.searchsorted(np.cumsum(widths[ids]), ends, "left") + 1
            low = 0
            for piece, high in zip(new, cuts.tolist()):
                known.put(piece, ids[low:high].tobytes())
                low = high

        def whole(piece: str) -> bytes:
            return _packed(encoding.encode_ordinary(piece))

        # One call learns many pieces cheaply, so a smaller memory does.
        rest = Ids(lambda piece: whole(" " + piece), PIECES // 4)
        return Encoder(byte_pieces, Ids(whole, PIECES // 40), rest, learn)

    return once(("tokens", "ranks", path, pattern), make)


def rank_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""

    def make():
        ranks = read_ranks(path)
        made = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            made[rank] = token
        return made

    return once(("tokens", "rank bytes", path), make)
