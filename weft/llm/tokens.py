"""Ids of whole texts by a public tokenizer file: each distinct cut of a batch goes through the library once.

Both vocabularies split a text before merging, so a text's ids are those of its cuts in order, where cuts are made at spaces
at which such a split is certain. A batch's distinct cuts that aren't remembered are joined with marks between that become
an id of their own, encoded by one call, and told apart by that id. What is remembered is kept as Arrow and numpy arrays of
at most REMEMBERED bytes.

Texts that hold the beginning of a special token's string, and cuts whose ends are white space, go through the library as
they are. special_as_text: strings of special tokens in a text are ordinary text; else they become those tokens' ids, which
is what the library does by itself.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered cuts and ids, in each of two tables.
REMEMBERED = 32 << 20
#: Before one space between two characters that aren't white space, the byte-level rule always starts a piece.
ONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: A superset of what either library takes for white space, for the regular expressions of Arrow.
SPACE = r"[\x00-\x20\x{7F}-\x{A0}\x{180E}\x{200B}\p{Z}]"
SPECIAL = "<|"
#: All ASCII marks but the apostrophe, with which contractions begin.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Cuts that one call of the library gets.
CALL = 4096


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet (a fixed rule): a printable byte stands for itself, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


ALPHABET = byte_characters()
SPACE_LETTER = ALPHABET[32]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(values: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Runs of values, of the lengths many from begin on, one after the other."""
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin - (ends - many), many) + np.arange(total)]


class Table:
    """Distinct cuts and their ids, within bounds. make: ids and lengths of cuts that it lacks; tails: the table of marks after a word."""

    def __init__(self, make, tails: Table | None = None):
        self.make, self.tails = make, tails or self
        self._clear()

    def _clear(self) -> None:
        self.cuts, self.begin, self.many, self.ids = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def size(self) -> int:
        return self.cuts.nbytes + self.begin.nbytes + self.many.nbytes + self.ids.nbytes

    def _add(self, cuts: pa.Array, ids: np.ndarray, many: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(many) - many])
        self.many, self.ids = np.concatenate([self.many, many]), np.concatenate([self.ids, ids])
        self.cuts = pa.concat_arrays([self.cuts, cuts])

    def _known(self, cuts: pa.Array) -> np.ndarray:
        """Places of distinct cuts, all of which are known after."""
        at = pc.index_in(cuts, value_set=self.cuts)
        new = cuts.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            at[at < 0] = len(self.cuts) + np.arange(len(new))
            self._add(new, *self.make(new))
        return at

    def look_up(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cuts: distinct. All ids known then, and where each cut's begin there and how many they are.

        Marks after a letter or digit begin a piece, so a new cut with such is what comes before, then the marks.
        """
        if self.size() > REMEMBERED:
            self._clear()
        # The known ones are hashed anew for each call, so all is asked at once.
        heads = pc.ascii_rtrim(cuts, MARKS)
        at = pc.index_in(pa.concat_arrays([cuts, heads]), value_set=self.cuts).fill_null(-1).to_numpy().astype(np.int64)
        at, head_at = at[: len(cuts)], at[len(cuts) :]
        is_new = at < 0
        if is_new.any():
            new, heads = cuts.filter(pa.array(is_new)), heads.filter(pa.array(is_new))
            mask = pc.and_(pc.not_equal(heads, new), pc.match_substring_regex(heads, "[A-Za-z0-9]$"))
            marked = mask.to_numpy(zero_copy_only=False)
            own = np.where(marked, head_at[is_new], -1)
            parts = pc.if_else(mask, heads, new).filter(pa.array(own < 0)).dictionary_encode()
            own[own < 0] = len(self.cuts) + parts.indices.to_numpy()
            if len(parts.dictionary):
                self._add(parts.dictionary, *self.make(parts.dictionary))
            if marked.any():
                new, heads = new.filter(mask), heads.filter(mask)
                tails = pa.array([x[len(y) :] for x, y in zip(new.to_pylist(), heads.to_pylist())], pa.string()).dictionary_encode()
                head, tail = own[marked], self.tails._known(tails.dictionary)[tails.indices.to_numpy()]
                begin = np.stack([self.begin[head], len(self.ids) + self.tails.begin[tail]], 1).ravel()
                many = np.stack([self.many[head], self.tails.many[tail]], 1)
                own[marked] = len(self.cuts) + np.arange(len(new))
                self._add(new, gather(np.concatenate([self.ids, self.tails.ids]), begin, many.ravel()), many.sum(1))
            at[is_new] = own
        return self.ids, self.begin[at], self.many[at]


class Encoder:
    """Texts to ids. words: the word vocabulary, which drops white space."""

    def __init__(self, path: str, words: bool, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.words, self.library = words, Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special_as_text = special_as_text
        # Cuts are distinct, so the library needn't remember any.
        self.model = self.library.model
        self.model._resize_cache(0)
        self.library.model = self.model
        # Between two cuts: a tab before a space or another character, or a control character between spaces, is a piece.
        self.between = " \x01 " if words else "\t"
        self.mark = self._ids(self.between)
        assert len(self.mark) == 1
        self.first = Table(lambda cuts: self._make(cuts, ""))
        self.rest = Table(lambda cuts: self._make(cuts, "" if words else " "), self.first)
        self.line, self.feed = Table(self._after_line, self.first), self._ids("\n")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _make(self, cuts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Letters alone are one piece, which the library's model merges; other cuts are joined."""
        letters = pc.utf8_is_alpha(cuts).to_numpy(zero_copy_only=False)
        parts = [self._pieces(cuts.filter(pa.array(letters)).to_pylist(), lead), self._joined(cuts.filter(pa.array(~letters)).to_pylist(), lead)]
        many, place = np.concatenate([m for _, m in parts]), np.empty(len(cuts), np.int64)
        place[np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])] = np.arange(len(cuts))
        begin = np.cumsum(many) - many
        return gather(np.concatenate([i for i, _ in parts]), begin[place], many[place]), many[place]

    def _after_line(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of cuts after a line feed, which is a piece of its own between other characters."""
        ids, many = self._make(cuts, "")
        return np.insert(ids, np.cumsum(many) - many, self.feed[0]), many + 1

    def _pieces(self, cuts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        ids, many, tokenize = [], [], self.model.tokenize
        for x in cuts:
            if self.words:
                x = x.lower() if x.isascii() else self.library.normalizer.normalize_str(x)
            x = lead + x
            found = tokenize(x.replace(" ", SPACE_LETTER) if x.isascii() else x.encode().decode("latin-1").translate(ALPHABET))
            ids += [t.id for t in found]
            many.append(len(found))
        return np.array(ids, np.uint32), np.array(many, np.int64)

    def _joined(self, cuts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        out, many = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(cuts), CALL):
            own = cuts[k : k + CALL]
            ids = self._ids(lead + (self.between + lead).join(own))
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            assert len(ends) == len(own)
            out.append(np.delete(ids, ends[:-1]))
            many.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(out), np.concatenate(many)

    def _odd(self, cuts: pa.Array) -> np.ndarray:
        """Whether a cut must not stand between two others."""
        if self.words:
            return pc.match_substring(cuts, "\x01").to_numpy(zero_copy_only=False)
        return pc.match_substring_regex(cuts, f"^$|^{SPACE}|{SPACE}$|\t").to_numpy(zero_copy_only=False)

    def _lists(self, lists: pa.ListArray, whole: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """lists: each text's cuts; byte-level, all but the first come after a space that was left out or begin with a line feed.
        whole: texts that must go through the library as they are. Ids, and how many each text has."""
        ends = lists.offsets.to_numpy().astype(np.int64)
        begin, n_cuts = ends[:-1] - ends[0], np.diff(ends)
        flat = lists.flatten()
        kind = np.zeros(len(flat), np.int8)
        if not self.words:
            kind[pc.starts_with(flat, "\n").to_numpy(zero_copy_only=False)] = 2
            kind[begin[n_cuts > 0]] = 1
        at, many, stores, shift = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), [], 0
        bad = np.zeros(len(flat), bool)
        for k, table in enumerate((self.rest, self.first, self.line)):
            where = np.flatnonzero(kind == k)
            if not len(where):
                continue
            cuts = flat if len(where) == len(flat) else flat.take(pa.array(where))
            coded = (pc.utf8_slice_codeunits(cuts, 1) if table is self.line else cuts).dictionary_encode()
            number, odd = coded.indices.to_numpy(), self._odd(coded.dictionary)
            store, b, m = table.look_up(coded.dictionary.filter(pa.array(~odd)))
            own_begin, own_many = np.zeros((2, len(odd)), np.int64)
            own_begin[~odd], own_many[~odd] = b + shift, m
            at[where], many[where], bad[where] = own_begin[number], own_many[number], odd[number]
            stores.append(store)
            shift += len(store)
        of = np.repeat(np.arange(len(lists)), n_cuts)
        whole = whole.copy()
        whole[of[bad]] = True
        many[whole[of]] = 0
        ids = gather(np.concatenate(stores) if len(stores) > 1 else stores[0], at, many) if stores else np.empty(0, np.uint32)
        count = np.bincount(of, many, len(lists)).astype(np.int64)
        if not whole.any():
            return ids, count
        # These few are put in between.
        out, ends, done = [], np.cumsum(count), 0
        for k in np.flatnonzero(whole).tolist():
            own = text_of(k)
            out += [ids[done : ends[k]], own]
            done, count[k] = int(ends[k]), len(own)
        return np.concatenate([*out, ids[done:]]), count

    def _spaced(self, text: str) -> np.ndarray:
        """A text with odd white space: cut where one space is between other characters; a cut that is odd still goes by itself."""
        cuts = ONE_SPACE.split(text)
        if len(cuts) == 1 or not self.special_as_text and SPECIAL in text:
            return self._ids(text)
        coded = pa.array([x[1:] for x in cuts[1:]], pa.string()).dictionary_encode()
        number, odd = coded.indices.to_numpy(), self._odd(coded.dictionary)
        store, own_begin, own_many = self.rest.look_up(coded.dictionary.filter(pa.array(~odd)))
        begin, many = np.zeros((2, len(odd)), np.int64)
        begin[~odd], many[~odd] = own_begin, own_many
        out, done = [self._ids(cuts[0])], 0
        for k in [*np.flatnonzero(odd[number]).tolist(), len(number)]:
            out.append(gather(store, begin[number[done:k]], many[number[done:k]]))
            if k < len(number):
                out.append(self._ids(cuts[k + 1]))
            done = k + 1
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings, none null. All ids one after the other, and how many each text has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = np.zeros(len(texts), bool)
        if not self.special_as_text:
            whole = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        if self.words:
            return self._lists(pc.ascii_split_whitespace(texts), whole, lambda k: self._ids(texts[k].as_py()))
        return self._lists(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), whole, lambda k: self._spaced(texts[k].as_py()))


@cache
def encoder(path: str, words: bool, special_as_text: bool = False) -> Encoder:
    """One for each Python worker, so that what it remembers serves all tasks there."""
    return Encoder(path, words, special_as_text)
