"""Token ids of a public byte-level BPE vocabulary, by the `tokenizers` library.

The library's own splitting and offset keeping costs most of its time. So texts are
cut to words by the splitter's rule, a batch at a time, and the ids of each distinct
word are worked out once by the library's BPE model and kept within a bound. Strings
of added tokens (such as `<|endoftext|>`) are cut out before all else and give their
own id. The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`.

The rule (`public_tokenizers.PATTERN`): letters, numbers and other characters make
words of their own, each with one blank before it; `'s 't 'm 'd 're 've 'll` are
words where one may begin; of white space before a word all but the last character
is one word.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT = "byte_bpe_50k.json"
#: Words, and ids of words, kept by a worker before it starts anew.
KEEP, KEEP_IDS = 300_000, 2_000_000
#: Words looked up at once; bytes cut at once, and one text at least.
SOME, SOME_BYTES = 1 << 19, 4 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _kind(point: int) -> int:
    if point in _WHITE:
        return _SPACE
    c = chr(point)
    return _LETTER if c.isalpha() else _NUMBER if unicodedata.category(c)[0] == "N" else _OTHER


def vocabulary_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for
    themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    return letters | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}


#: Joins words for one call of the model. The byte 0xFF is in no UTF-8 text, so
#: the vocabulary has no merge with its letter and words stay apart.
_APART = chr(255)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each begins and ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pick(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[first : first + size] of every row, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Cuts texts to the splitter's words."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, np.uint8)  # filled as characters come
        self.kinds[:128] = [_kind(c) for c in range(128)]

    def cut(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where each word begins. starts: where each text does; data isn't empty."""
        places = None
        points = data
        if data.max() >= 128:
            places = np.flatnonzero((data & 0xC0) != 0x80)
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            for c in np.unique(points[self.kinds[points] == 0]):
                self.kinds[c] = _kind(int(c))
        kinds, n = self.kinds[points], len(points)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(places, starts) if places is not None else starts] = True
        begins = first.copy()
        begins[1:n] |= kinds[1:] != kinds[:-1]
        # The last white space before a word stands alone, and a blank joins the word.
        last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~first[1:n])
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
        # Short forms after an apostrophe with which a word begins.
        mark = np.flatnonzero((points == 39) & begins[:n])
        if len(mark):
            near, far = (np.where(mark + k < n, points[np.minimum(mark + k, n - 1)], 0) for k in (1, 2))
            near = np.where(first[mark + 1], 0, near)
            far = np.where(first[np.minimum(mark + 2, n)], 0, far)
            short = np.isin(near, [ord(c) for c in "stmd"])
            long = (near == ord("r")) & (far == ord("e")) | (near == ord("v")) & (far == ord("e")) | (near == ord("l")) & (far == ord("l"))
            begins[mark[short | long] + 1] = False
            begins[mark[short] + 2] = True
            begins[mark[long] + 3] = True
        at = np.flatnonzero(begins[:n])
        return at if places is None else places[at]


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        self.model._resize_cache(0)
        self.letters = _byte_letters()
        self.apart = self.model.token_to_id(_APART)
        added = whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in what is beside them aren't known")
        self.added = {t.content: k for k, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.words = Words()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.again = np.zeros(KEEP + SOME, bool)  # words met in more than one lot
        self.first = np.zeros(1, np.int64)
        self.known = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        """Keeps the words met again, if they aren't too many."""
        keep = np.flatnonzero(self.again[: len(self.at)])
        names, first, known = list(self.at), self.first, self.known
        self._clear()
        sizes = first[keep + 1] - first[keep]
        if len(keep) <= KEEP // 2 and sizes.sum() <= KEEP_IDS // 2:
            self.at = {names[k]: n for n, k in enumerate(keep)}
            self.known = pick(known, first[keep], sizes)
            self.first = np.concatenate([self.first, np.cumsum(sizes)])

    def _learn(self, words: list[bytes]) -> None:
        found, sizes = [self.known], []
        for k in range(0, len(words), 256):
            letters = b"\xff".join(words[k : k + 256]).decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(letters)], np.uint32)
            gaps = np.append(np.flatnonzero(ids == self.apart), len(ids))
            found.append(np.delete(ids, gaps[:-1]))
            sizes.append(np.diff(gaps, prepend=-1) - 1)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.known = np.concatenate(found)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """A number for each word; `first` and `known` hold its ids until the next
        call."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        look_up = lambda: np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        number = look_up()
        new = np.flatnonzero(number < 0)
        if len(new) and (len(self.at) + len(new) > KEEP or len(self.known) > KEEP_IDS):
            self._shrink()
            number = look_up()
            new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            number[new] = np.arange(len(self.at), len(self.at) + len(new))
            self._learn([names[k] for k in new])
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def _cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and where each text's begin."""
        at = np.append(self.words.cut(data, starts[:-1]), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        ids, sizes = [], []
        for k in range(0, len(words), SOME):
            number = self._numbers(words.slice(k, SOME))
            first = self.first[number]
            sizes.append(self.first[number + 1] - first)
            ids.append(pick(self.known, first, sizes[-1]))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), ends[np.searchsorted(at[:-1], starts)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = bytes_of(texts)
        ids, sizes, k = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(starts, starts[k] + SOME_BYTES, "right")) - 1)
            own = data[starts[k] : starts[end]]
            found, begin = self._cut(own, starts[k : end + 1] - starts[k]) if len(own) else (ids[0], np.zeros(end - k + 1, np.int64))
            ids.append(found)
            sizes.append(np.diff(begin))
            k = end
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Null
        and empty texts have none."""
        if not any(pc.any(pc.match_substring(texts, name)).as_py() for name in self.added):
            return self._plain(texts)
        row, segment, own = [], [], []
        for k, text in enumerate(texts.to_pylist()):
            for j, piece in enumerate(self.marks.split(text or "")):
                row.append(k)
                segment.append("" if j % 2 else piece)
                own.append(self.added[piece] if j % 2 else -1)
        ids, sizes = self._plain(pa.array(segment, pa.large_string()))
        marks = np.array(own) >= 0
        ids = np.insert(ids, np.cumsum(sizes)[marks], np.array(own)[marks])
        return ids, np.bincount(row, sizes + marks, len(texts)).astype(np.int64)

    def ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with the id `end` after each text."""
        ids, sizes = self.encode(texts)
        return np.insert(ids, np.cumsum(sizes), end).astype("<u4", copy=False), sizes + 1


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One for each worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
