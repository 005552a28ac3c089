"""Token ids by a ``tokenizers`` file, through a cache of words.

Both kinds of file that are used here split a text at each change from other characters to white space before they
merge bytes, so a text's ids are the ids of its words in turn. Words repeat; each worker keeps those it has met. A
word that itself starts or ends with white space could share a run of it with its neighbour, and one that holds a
special token is split elsewhere: its text is encoded whole. So the ids are the library's own for every text.

Most of a corpus's different words are rare, and what costs is to encode them for the first time. Many differ only
in the marks at their end or in a line feed where a space was; these are put together from parts that are known.

That a file does split so is tried when it is opened (``splits_at_spaces``, ``splits_at_marks``): if any of the
probes comes out otherwise, every text (or word) is encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

#: Words kept by a worker; from so many on, its cache starts anew (about 200 bytes a word).
CACHE_WORDS = 600_000
#: Characters that are encoded together.
AT_ONCE = 7_000_000
#: Words that are handed to the library as one text, a special token between them.
JOINED = 64
#: Words that are handed over in one call.
LEARNED = 8192
#: Characters that part from a letter or digit before them.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Words that a file must treat alike alone and beside each other.
PROBES = "a The it's 's don't x1 12 3.5 . ... -- (b) c, d! \u00e9t\u00e9 e\u0301 \u0301f \u00df \u03a3\u03a3 \u4e2d\u6587 \u3042 \U0001f600 a\tb c\nd \u00a0e f\u00a0g _h i_ <k> 1,000 \u0661 l\u200bm".split(" ")


#: Letters and digits that any version of Unicode has.
PLAIN = frozenset(chr(i) for i in range(0x250) if chr(i).isalnum())


def strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned integers of ``type``."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content.split()[0]) for t in added.values() if t.content.split()) or r"(?!)")
        plain = [(i, t.content) for i, t in sorted(added.items()) if t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.between = plain[0] if plain else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.type).tobytes()
        self.forget()
        self.letters, self.plain = self.letter_table()
        self.by_word, self.by_part = self.splits_at_spaces(), self.splits_at_marks()

    def forget(self) -> None:
        """Row of each word known (after a space, and at a text's start); by row: where its ids lie in ``table``."""
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.start, self.length, self.odd = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.table, self.rows, self.ids = np.zeros(4096, self.type), 0, 0

    def splits_at_spaces(self) -> bool:
        pairs = [f"{a} {b}" for a in PROBES for b in PROBES]
        good = [w for w in PROBES if w == w.strip()]
        alone = {b + w: x for b in ("", " ") for w, x in zip(good, self.whole([b + w for w in good]), strict=True)}
        return all(a not in alone or f" {b}" not in alone or x == alone[a] + alone[f" {b}"] for (a, b), x in zip(((a, b) for a in PROBES for b in PROBES), self.whole(pairs), strict=True))

    def letter_table(self) -> tuple[dict[int, str] | None, str]:
        """What the model gets for each plain letter (and for a space before a word), as the file's own normalizer
        and pre-tokenizer say, and a pattern of the words made of them; None where a letter's piece is not its own
        or trial words come out otherwise."""
        t = self.tokenizer

        def pieces(text: str) -> list[str]:
            text = t.normalizer.normalize_str(text) if t.normalizer else text
            return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

        table, space = {}, None
        for c in sorted(PLAIN):
            if c.isalpha() and len(found := pieces(c)) == 1:
                after = pieces(f" {c}")
                if len(after) != 1 or not after[0].endswith(found[0]) or space not in (None, after[0][: -len(found[0])]):
                    return None, ""
                space = after[0][: -len(found[0])]
                table[ord(c)] = found[0]
        if not table or any("\n" in x for x in table.values()):
            return None, ""
        plain = "^ ?[" + "".join(map(chr, table)) + "]+$"
        trial = [before + w for before in ("", " ") for w in ("a", "Hello", "WORLD", "\u00e9t\u00e9", "Gr\u00f6\u00dfe", "na\u00efvet\u00e9", "xqzvkj", "".join(map(chr, table)), "internationalization") if all(ord(c) in table for c in w)]
        found = [[x.id for x in t.model.tokenize(w.translate(table | {32: space}))] for w in trial]
        good = [np.array(x, self.type).tobytes() for x in found] == self.whole(trial)
        return (table | {32: space}, plain) if good else (None, "")

    def splits_at_marks(self) -> bool:
        for w in ("a.", "It's,", "\u00e9t\u00c9!?", "x1$$$", "12...", "a-b)]", "\u00df\u00e8:;", "a.\nB", "a\nb", "a.\n(b),\n1", "Ab***\nCd%%%"):
            for before in ("", " "):
                parts = [(kind or "") + part for kind, part in self.parts(w, before)]
                if b"".join(self.whole(parts)) != self.whole([before + w])[0]:
                    return False
        return all(self.whole(["q" + m])[0] == b"".join(self.whole(["q", m])) for m in MARKS)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.type).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of any number of texts, AT_ONCE characters at a time."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= AT_ONCE:
                out += self.batch(held)
                held, size = [], 0
        return out + self.batch(held) if held else out

    def batch(self, texts: list[str]) -> list[bytes]:
        """Arrow finds the distinct words, each is looked up once, and numpy puts the ids of all words in place."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            return [x + self.end for x in self.whole(texts)]
        if self.rows > CACHE_WORDS:
            self.forget()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, which = strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        heads = [words[i] for i in which[at[:-1]]]
        which[at[:-1]] = np.arange(len(heads)) + len(words)  # a first word has no space before it
        row = np.concatenate([self.look_up(self.inner, words, " "), self.look_up(self.first, heads, "")])[which]
        each = self.length[row]
        ends = np.cumsum(each)
        ids = self.table[np.repeat(self.start[row] - (ends - each), each) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[at]
        bad = np.add.reduceat(self.odd[row], at[:-1]) > 0
        return [(self.whole([t])[0] if w else ids[a:b].tobytes()) + self.end for t, a, b, w in zip(texts, cuts.tolist(), cuts[1:].tolist(), bad.tolist(), strict=False)]

    def look_up(self, known: dict[str, int], words: list[str], before: str) -> np.ndarray:
        """The row of each word. One with white space at its ends or a special token is odd and has no ids."""
        rows = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(rows < 0)):
            met = [words[i] for i in new.tolist()]
            self.learn(known, list(dict.fromkeys(met)), before)
            rows[new] = np.fromiter(map(known.__getitem__, met), np.int64, len(met))
        return rows

    def learn(self, known: dict[str, int], words: list[str], before: str) -> None:
        """New rows. A word in parts has the ids of its parts in turn, each known or learned first."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pa.array(words, pa.large_string())
        odd = pc.not_equal(pc.utf8_trim_whitespace(text), text)
        if self.special.search("\0".join(words)):
            odd = pc.or_(odd, pa.array([bool(self.special.search(w)) for w in words]))
        if before:
            odd = pc.or_(odd, pc.equal(text, ""))
        if not self.by_part:
            lined = tailed = pa.array(np.zeros(len(words), bool))
        else:
            lined = pc.and_not(pc.match_substring(text, "\n"), odd)
            stem = pc.utf8_rtrim(text, MARKS)
            ends = pc.is_in(pc.utf8_slice_codeunits(stem, -1), pa.array(sorted(PLAIN), pa.large_string()))
            tailed = pc.and_not(pc.and_not(pc.and_(ends, pc.not_equal(stem, text)), odd), lined)
        whole = strings(text.filter(pc.invert(pc.or_(pc.or_(odd, lined), tailed))))
        named, stems = strings(text.filter(tailed)), strings(stem.filter(tailed)) if self.by_part else []
        tails = [w[len(s) :] for w, s in zip(named, stems, strict=True)]
        of_lines = [(w, self.parts(w, before)) for w in strings(text.filter(lined))]
        wanted = {before: dict.fromkeys(whole), None: dict.fromkeys(tails)}
        wanted[before].update(dict.fromkeys(s for s in stems if s not in known))
        for w, parts in of_lines:
            for kind, part in parts or ((before, w),):
                wanted.setdefault(kind, {})[part] = None
        kinds = {" ": self.inner, "": self.first, None: self.tails}
        for kind, every in wanted.items():
            if new := [w for w in every if w not in kinds[kind]]:
                self.append(kinds[kind], new, *self.words_ids([(kind or "") + w for w in new]))
        if named:
            at = np.empty(2 * len(named), np.int64)
            at[::2] = np.fromiter(map(known.__getitem__, stems), np.int64, len(stems))
            at[1::2] = np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails))
            self.compose(known, named, at, np.full(len(named), 2))
        if of_lines := [(w, parts) for w, parts in of_lines if parts]:
            at = np.array([kinds[kind][part] for _, parts in of_lines for kind, part in parts], np.int64)
            self.compose(known, [w for w, _ in of_lines], at, np.array([len(parts) for _, parts in of_lines]))
        none = strings(text.filter(odd))
        self.append(known, none, np.zeros(0, self.type), np.zeros(len(none), np.int64), odd=True)

    def compose(self, known: dict[str, int], words: list[str], at: np.ndarray, n_parts: np.ndarray) -> None:
        """Words from the ids of parts: ``n_parts`` of the rows ``at`` for each word."""
        each = self.length[at]
        ends = np.cumsum(each)
        ids = self.table[np.repeat(self.start[at] - (ends - each), each) + np.arange(ends[-1])]
        self.append(known, words, ids, np.diff(ends[np.cumsum(n_parts) - 1], prepend=0))

    @staticmethod
    def parts(w: str, before: str) -> list[tuple[str | None, str]] | None:
        """(kind, part): lines, the line feeds between them, and marks at the end of each; None for a word that is
        one part. A mark parts only from PLAIN."""
        out: list[tuple[str | None, str]] = []
        for line in w.split("\n") if "\n" in w else (w,):
            if out:
                out.append((None, "\n"))
                before = ""
            if not line or line != line.strip():
                return None
            stem = line.rstrip(MARKS)
            if len(stem) < len(line) and stem and stem[-1] in PLAIN:
                out += ((before, stem), (None, line[len(stem) :]))
            else:
                out.append((before, line))
        return out if len(out) > 1 else None

    def append(self, known: dict[str, int], words: list[str], ids: np.ndarray, n: np.ndarray, *, odd: bool = False) -> None:
        size, many = self.rows + len(words), self.ids + len(ids)
        for name, least in (("start", size), ("length", size), ("odd", size), ("table", many)):
            held = getattr(self, name)
            if least > len(held):
                grown = np.zeros(max(least, 3 * len(held) // 2), held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)
        self.start[self.rows : size] = self.ids + np.cumsum(n) - n
        self.length[self.rows : size], self.odd[self.rows : size] = n, odd
        self.table[self.ids : many] = ids
        known.update(zip(words, range(self.rows, size), strict=True))
        self.rows, self.ids = size, many

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many each word has."""
        if not words:
            return np.zeros(0, self.type), np.zeros(0, np.int64)
        if self.letters:
            return self.letters_ids(words)
        return self.library_ids(words)

    def letters_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, with words of plain letters straight from the model: they are one piece each, whose text is that
        of its letters in turn."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pa.array(words, pa.large_string())
        plain = pc.match_substring_regex(text, self.plain)
        some = strings(text.filter(plain))
        if len(some) < len(words) // 8:
            return self.library_ids(words)
        tokenize, flat, ends = self.tokenizer.model.tokenize, [], []
        for piece in "\n".join(some).translate(self.letters).split("\n") if some else ():
            flat += [t.id for t in tokenize(piece)]
            ends.append(len(flat))
        rest, n_rest = self.library_ids(strings(text.filter(pc.invert(plain))))
        mask = plain.to_numpy(zero_copy_only=False)
        n = np.empty(len(words), np.int64)
        n[mask], n[~mask] = np.diff(np.array(ends, np.int64), prepend=0), n_rest
        ids = np.empty(int(n.sum()), self.type)
        of_plain = np.repeat(mask, n)
        ids[of_plain], ids[~of_plain] = np.array(flat, self.type), rest
        return ids, n

    def library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Special tokens are cut out before anything else is done, so words with one between them are encoded as if
        alone."""
        if not words:
            return np.zeros(0, self.type), np.zeros(0, np.int64)
        parts, counts = [], []
        for i in range(0, len(words), LEARNED):  # the library's own results are large
            some = words[i : i + LEARNED]
            if self.between:
                mark, text = self.between
                joined = self.tokenizer.encode_batch_fast([text.join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
                flat = np.concatenate([np.array([*x.ids, mark], np.int64) for x in joined])
                marks = np.flatnonzero(flat == mark)
                if len(marks) == len(some):
                    parts.append(flat[flat != mark].astype(self.type))
                    counts.append(np.diff(marks, prepend=-1) - 1)
                    continue
            each = self.whole(some)
            parts.append(np.frombuffer(b"".join(each), self.type))
            counts.append(np.fromiter(map(len, each), np.int64, len(each)) // self.type.itemsize)
        return np.concatenate(parts), np.concatenate(counts)


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One for each file and worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def forget_all() -> None:
    _encoders.clear()


def as_u32(ids: bytes, kind: np.dtype) -> bytes:
    return np.frombuffer(ids, kind).astype("<u4").tobytes()
