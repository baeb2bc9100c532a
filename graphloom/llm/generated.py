"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.syntax import fault, source_ending
from graphloom.llm.textops import mix
from graphloom.session import Scratch, keyed

#: Tokens of a masked shingle.
SHINGLE = 5
#: MinHash bands and rows: at a similarity of 0.8 a pair meets in some band with probability 0.998.
BANDS, ROWS = 20, 6
SIMILAR = 0.8
#: Repetition from which a file is mechanical, and share of characters in literals from which it is data.
MECHANICAL, LITERAL = 0.7, 0.5

#: Comments and strings; names, numbers and marks never begin inside them.
_CUT = re.compile(
    r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.*?)(?:"""|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|`[^`]*`?', re.S
)
#: Words of the four languages that masking keeps.
KEYWORDS = frozenset(
    "abstract as async await boolean break byte case catch char class companion const constructor continue data declare default do double else enum export extends false final finally float for from fun function get if implements import in init int interface internal is let long module namespace new null object of open override package private protected public readonly return set short static super switch this throw throws true try type typeof val var void when while yield".split()
)
_HEADER_LINE = re.compile(r"\s*(?://|/\*|\*|#|<!--|;;|--)")
#: A file's own statement, in its head comment, that a machine wrote it.
GENERATED_STATEMENT = re.compile(
    r"(?i)<auto-?generated|auto-?generated|@generated\b|(?:code|file|class|source|module|this)\s+(?:is\s+|was\s+|has been\s+|were\s+)?(?:automatically\s+|machine\s+|auto\s*-?)?(?:generated|produced|emitted|created)\s+(?:by|from|with|using)\b"
    r"|(?:automatically|machine)[ -](?:generated|produced|written|created|made)|generated\s+(?:by|from|code|file|source)\b|do\s+not\s+(?:edit|modify|change)|not\s+(?:to\s+)?(?:be\s+)?(?:edit|modif|chang)\w*\s+(?:by hand|manually)"
    r"|(?:changes|edits|modifications)\s+(?:to this file\s+)?(?:will|may)\s+be\s+(?:lost|overwritten)|(?:erzeugt|generiert|erstellt)\s+(?:von|durch|mit|aus)\b|nicht\s+von\s+hand|g[ée]n[ée]r[ée]\s+(?:par|automatiquement)|ne\s+pas\s+(?:modifier|[ée]diter)|generado\s+(?:por|autom)|no\s+(?:editar|modificar)|generato\s+(?:da|automaticamente)"
)
#: Banners of third parties in the head comment.
VENDOR_BANNER = re.compile(
    r"(?i)\A\s*/\*!|@licen[sc]e\b|\bvendored\b|(?:copied|taken|adapted|imported|forked)\s+(?:over\s+)?(?:verbatim\s+)?from\s+(?:https?://|upstream)|redistribut\w+\s+(?:is|and use|permitted|allowed)|keep in sync with upstream|spdx-license-identifier|licensed under|permission is hereby granted|project contributors"
)
BUILD_PLACES = ("build", "target", "dist", "out", "bin/generated", "generated", "gen", "coverage", ".next", ".nuxt", ".gradle", "obj")
VENDOR_PLACES = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "extern", "external", "externals", "libs/external", "lib/external", "Pods", "deps", "contrib/vendor")


_LINE = re.compile(r"[^\r\n]+")


_WORD, _DIGIT = 1, 2
_NAME_CODE, _NUMBER_CODE, _STRING, _OTHER_LETTER, _OTHER_MARK = 90, 91, "\x00", "\xaa", "\xa7"
#: Kind of every character: part of a word, digit, or neither; and the token of every mark.
_KIND = np.array([_DIGIT if chr(c) in "0123456789" else _WORD if chr(c) in "_$" or chr(c).isalnum() else 0 for c in range(128)] + [_WORD] * 128, np.uint8)
_MARK = np.array([0 if chr(c).isspace() or _KIND[c] else c | 0x80 for c in range(128)] + [0xFF] * 128, np.uint8)
_KIND[ord(_OTHER_MARK)] = 0
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_keys(b: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each word, from its first and last eight letters and its length."""
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)
    mask = _LOW_BYTES[np.minimum(length, 8)]
    first, last = (eight[at].reshape(-1).view("<u8") & mask for at in (starts, starts + np.maximum(length - 8, 0)))
    return mix(mix(first + length.astype(np.uint64)) ^ last)


def _keyword_table() -> tuple[np.ndarray, np.ndarray]:
    """For every first 16 bits of a word's number: the number and the token of the keyword that has them."""
    words = sorted(KEYWORDS)
    b = np.frombuffer(b"".join(w.encode().ljust(16, b"\0") for w in words), np.uint8)
    keys = _word_keys(b, np.arange(len(words)) * 16, np.array([len(w) for w in words]))
    slot = (keys >> np.uint64(48)).astype(np.int64)
    assert len(np.unique(slot)) == len(words)
    table, codes = np.zeros(1 << 16, np.uint64), np.full(1 << 16, _NAME_CODE, np.uint8)
    table[slot], codes[slot] = keys, np.arange(1, len(words) + 1)
    return table, codes


_KEYWORD_KEYS, _KEYWORD_CODES = _keyword_table()
#: Characters of texts that are masked together, and about as many of the tokens whose sets are built together.
_TOGETHER = 1 << 18


def _plain(text: str) -> tuple[str, int]:
    """A text with strings as one character, without comments and rare characters, and the characters of its strings."""
    literal = 0

    def cut(m: re.Match) -> str:
        nonlocal literal
        if m[0][0] == "/":
            return " "
        literal += m.end() - m.start()
        return _STRING

    plain = _CUT.sub(cut, text.replace(_STRING, " "))
    if not plain.isascii():
        plain = re.sub(r"[^\S\x00-\x7f]", " ", plain)
        plain = re.sub(r"[^\W\x00-\x7f]", _OTHER_LETTER, plain)
        plain = re.sub(r"[^\x00-\x7f\xaa]", _OTHER_MARK, plain)
    return plain, literal


def masked_tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """For each text one byte a token, without comments, and the characters of literals.

    Identifiers, numbers and strings become one byte each; keywords and ASCII marks keep theirs, other marks share one.
    """
    held: list[tuple[str, int]] = []
    size = 0
    for text in texts:
        held.append(_plain(text))
        size += len(held[-1][0])
        if size > _TOGETHER:
            yield from _masked(held)
            held, size = [], 0
    if held:
        yield from _masked(held)


def _masked(plain: list[tuple[str, int]]) -> Iterator[tuple[np.ndarray, int]]:
    b = np.frombuffer("\n".join(x for x, _ in plain).encode("latin-1") + b" " * 8, np.uint8)
    first = np.cumsum([0, *(len(x) + 1 for x, _ in plain)])
    kind = _KIND[b]
    dots = np.flatnonzero(b[1:-1] == 46) + 1
    dots = dots[(kind[dots - 1] == _DIGIT) & (kind[dots + 1] == _DIGIT)]
    word = kind > 0
    word[dots] = True  # the point of a number
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate([[0], edge]) if word[0] else edge
    starts, length = edge[::2], edge[1::2] - edge[::2]
    code = np.where(word, 0, _MARK[b]).astype(np.uint8)
    key = _word_keys(b, starts, length)
    slot = (key >> np.uint64(48)).astype(np.int64)
    number = kind[starts] == _DIGIT
    code[starts] = np.where(number, _NUMBER_CODE, np.where(_KEYWORD_KEYS[slot] == key, _KEYWORD_CODES[slot], _NAME_CODE))
    at = np.flatnonzero(code)
    tokens, cuts = code[at], np.searchsorted(at, first)
    digits = np.concatenate([[0], np.cumsum(length[number])])[np.searchsorted(starts[number], first)]
    for i, (_, literal) in enumerate(plain):
        yield tokens[cuts[i] : cuts[i + 1]], literal + int(digits[i + 1] - digits[i])


def head_comment(text: str) -> str:
    """The comment lines before any code, however many; of a line that goes on with code only the comment."""
    lines, block = [], False
    for m in _LINE.finditer(text):
        line = m[0]
        s = line.strip()
        if not block and s and not _HEADER_LINE.match(line):
            break
        begun = block or s.startswith("/*")
        end = line.find("*/", 0 if block else line.find("/*") + 2) if begun else -1
        if end >= 0 and (rest := line[end + 2 :]).strip() and not _HEADER_LINE.match(rest):
            lines.append(line[: end + 2])
            break
        lines.append(line)
        if "/*" in s and "*/" not in s.split("/*", 1)[1]:
            block = True
        elif block and "*/" in s:
            block = False
    return "\n".join(lines)


def _eights(tokens: np.ndarray) -> np.ndarray:
    """For every token the number that it and the seven bytes behind it make."""
    b = np.concatenate([tokens, np.zeros(8, np.uint8)])
    return np.ndarray(len(tokens), ">u8", b, strides=(1,)).astype(np.uint64)


def _windows(tokens: np.ndarray) -> np.ndarray:
    """The runs of SHINGLE tokens, each as the number its bytes make; of a shorter file the one run of all tokens."""
    k = min(SHINGLE, max(len(tokens), 1))
    return _eights(tokens)[: max(len(tokens) - k + 1, 0)] >> np.uint64(64 - 8 * k)


def _first_ones(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([np.ones(min(len(ordered), 1), np.bool_), ordered[1:] != ordered[:-1]])


def shingles_of(tokens: np.ndarray) -> np.ndarray:
    """Distinct shingles, in order."""
    out = np.sort(_windows(tokens))
    return out[_first_ones(out)]


def shingle_sets(files: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingles_of every file, one behind the other, with the places where files begin and the end of all; repetition of each file.

    files: tokens. Repetition is the share of ten-token windows that occurred before in the file.
    """
    length = np.array([len(x) for x in files], np.int64)
    ends = np.cumsum(length)
    begins = ends - length
    eights = _eights(np.concatenate([*files, np.zeros(0, np.uint8)]))
    five = eights >> np.uint64(64 - 8 * SHINGLE)
    short = np.flatnonzero((length > 0) & (length < SHINGLE))
    five[begins[short]] = eights[begins[short]] >> (64 - 8 * length[short]).astype(np.uint64)
    wide = mix(five)
    wide[:-SHINGLE] += five[SHINGLE:]

    def distinct(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ones of equal values among the first `count` of each file, which are put in order, and their numbers up to each file."""
        for a, b in zip(begins.tolist(), (begins + count).tolist(), strict=True):
            values[a:b].sort()
        first, inside = _first_ones(values), np.zeros(len(values) + 1, np.int8)
        np.add.at(inside, begins, count > 0)
        np.subtract.at(inside, begins + count, count > 0)
        first[begins[count > 0]] = True
        first &= np.cumsum(inside[:-1], dtype=np.int8) > 0
        return first, np.concatenate([[0], np.cumsum(first)])[np.concatenate([begins, [len(values)]])]

    windows = np.maximum(length - 2 * SHINGLE + 1, 0)
    _, places = distinct(wide, windows)
    repetition = np.where(windows > 0, 1 - np.diff(places) / np.maximum(windows, 1), 0.0)
    first, places = distinct(five, np.where(length < SHINGLE, np.minimum(length, 1), length - SHINGLE + 1))
    return five[first], places, repetition


def is_minified(text: str) -> bool:
    """Whether most code is in lines of 300 or more characters with hardly a blank."""
    every = text.splitlines()
    if not every or max(map(len, every)) < 300:
        return False
    lines = [x for x in every if not x.lstrip().startswith(("//", "*", "/*"))]
    long_ = [x for x in lines if len(x) >= 300]
    return bool(long_) and sum(map(len, long_)) > 0.5 * sum(map(len, lines)) and sum(x.count(" ") for x in long_) < 0.05 * sum(map(len, long_))


#: MinHash values of a set, of which the first BANDS * ROWS make the bands. A signature has two bits of each.
VALUES = 256
#: Values whose bits differ, of sets with a similarity of 0.8, are 38.4 (standard deviation 5.7); with more than so many sets are not compared.
APART = 64
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)).astype(np.uint32)
_FACTORS, _MASKS = _SEEDS[:VALUES] | np.uint32(1), _SEEDS[VALUES:]
_ROOM = np.empty((256, VALUES), np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest values of VALUES hash functions over a set."""
    return _minhash(mix(shingles))


def _minhash(mixed: np.ndarray) -> np.ndarray:
    x = (mixed >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), len(_ROOM)):
        part = x[at : at + len(_ROOM)]
        room = np.multiply(part, _FACTORS, out=_ROOM[: len(part)])
        np.minimum(low, np.bitwise_xor(room, _MASKS, out=room).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key a band for each row of MinHash values: the band's values and its number, hashed."""
    rows = low[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(low), axis=0)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def signatures(low: np.ndarray) -> np.ndarray:
    """Two bits of every MinHash value, as two planes, for each row of values: rows of bytes."""
    spread = low * np.uint32(0x9E3779B1)
    planes = np.concatenate([spread >> np.uint32(31), (spread >> np.uint32(30)) & np.uint32(1)], axis=1)
    return np.packbits(planes.astype(np.bool_), axis=1)


#: Classes of shingles whose numbers in a set are told as odd or even.
PARITIES = 512


def parities(mixed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sets of mixed shingles one behind the other, which classes of shingles are odd in number: rows of bytes.

    A class in which two sets differ here holds a shingle that they do not share, so a pair whose rows differ in more bits
    than a similar pair can have such shingles is not similar: no similar pair is lost, whatever the sets are.
    """
    n = len(places) - 1
    of = np.repeat(np.arange(n), np.diff(places)) * PARITIES + (mixed & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(of, minlength=n * PARITIES) & 1).astype(np.bool_).reshape(n, PARITIES), axis=1)


def _bits(words: np.ndarray) -> np.ndarray:
    """Bits set in each row of eight words."""
    n = np.bitwise_count(words).view(np.uint64)[:, 0]  # a byte for each word
    low = np.uint64(0x00FF00FF00FF00FF)
    return (((n & low) + (n >> np.uint64(8) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


_SKETCH = "doc_id long, project string, same long, n_shingles int, repetition double, literal_share double, minified boolean, stated boolean, banner boolean, bands array<long>, signature binary, tokens binary"


def _parts(tokens: Sequence[np.ndarray]) -> Iterator[slice]:
    """Neighbouring files whose sets and parities are built together."""
    at, size = 0, 0
    for i, x in enumerate(tokens):
        size += len(x) + PARITIES
        if size > _TOGETHER:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(tokens):
        yield slice(at, len(tokens))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, projects, texts, endings = (batch.column(i).to_pylist() for i in range(4))
        tokens, literals = zip(*masked_tokens(texts), strict=True)
        for part in _parts(tokens):
            shingles, places, repetitions = shingle_sets(tokens[part])
            mixed = mix(shingles)
            rows, low = [], []
            for i, (key, project, text, ending, masked, literal, repetition) in enumerate(zip(keys[part], projects[part], texts[part], endings[part], tokens[part], literals[part], repetitions.tolist(), strict=True)):
                share = literal / max(1, len(text))
                if (repetition >= MECHANICAL or share >= LITERAL) and fault(text, ending) == "written in another language":
                    repetition = share = 0.0  # another language's statements and comments mislead these tokens
                head, own = head_comment(text), slice(places[i], places[i + 1])
                same = int(np.array(xxhash.xxh64_intdigest(shingles[own].tobytes()), np.uint64).view(np.int64))
                low.append(_minhash(mixed[own]))
                stated, banner = (bool(head and p.search(head)) for p in (GENERATED_STATEMENT, VENDOR_BANNER))
                rows.append((key, project, same, int(places[i + 1] - places[i]), repetition, share, is_minified(text), stated, banner, zlib.compress(masked.tobytes(), 6)))
            low = np.array(low)
            *columns, packed = zip(*rows, strict=True)
            signature = np.concatenate([signatures(low), parities(mixed, places)], axis=1)
            arrays = [*columns, band_keys(low).view(np.int64).tolist(), [x.tobytes() for x in signature], packed]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(arrays, kinds, strict=True)], [x.split()[0] for x in _SKETCH.split(", ")])


#: A band's crowd is compared in blocks of so many classes, so that two blocks fit into a task's memory.
BLOCK = 8192
#: Cells of the table of sets and shingles that one comparison builds.
_CELLS = 1 << 27


class _Sets:
    """Sets of shingles by row, their elements numbered as they come."""

    def __init__(self, set_of: Callable[[int], np.ndarray]):
        self._of, self._codes = set_of, {}
        self._known, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray) -> None:
        new = [r for r in rows.tolist() if r not in self._codes]
        if not new:
            return
        sets = [self._of(r) for r in new]
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        fresh = np.setdiff1d(values, self._known, assume_unique=True)
        ids = np.concatenate([self._ids, np.arange(len(self._known), len(self._known) + len(fresh))])
        known = np.concatenate([self._known, fresh])
        order = np.argsort(known)
        self._known, self._ids = known[order], ids[order]
        codes = self._ids[np.searchsorted(self._known, values)][at]
        self._codes |= zip(new, np.split(codes, np.cumsum([len(x) for x in sets])[:-1]), strict=True)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sets of rows a[i] and b[i], which were added."""
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        width = -(-len(self._known) // 64) * 64
        if len(used) * width > _CELLS and len(a) > 1:
            h = len(a) // 2
            return np.concatenate([self.common(a[:h], b[:h]), self.common(a[h:], b[h:])])
        held = [self._codes[r] for r in used.tolist()]
        flags = np.zeros((len(used), width), np.bool_)
        flags[np.repeat(np.arange(len(used)), [len(x) for x in held]), np.concatenate(held)] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 8192):
            j = i + 8192
            out[i:j] = np.bitwise_count(bits[at[: len(a)][i:j]] & bits[at[len(a) :][i:j]]).sum(axis=1, dtype=np.int64)
        return out


def links_within(groups: np.ndarray, reps: np.ndarray, parts: np.ndarray, sizes: np.ndarray, planes: np.ndarray, set_of: Callable[[int], np.ndarray], batch: int = 200_000, odd: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (rep, rep) between similar sets of one group, enough to connect all that similar pairs connect.

    Rows of equal group stand together; parts: equal numbers within a group are connected before.
    planes: signatures, rows of uint64; odd: parities, rows of uint64, if there are any; set_of(row) gives a row's set. Every
    pair whose sizes and parities allow the similarity and whose signatures are near is compared exactly, unless its ends are
    connected by then, so a group of sets that are all alike gives one link less than it has sets.
    """
    order = np.lexsort((sizes, groups))
    groups, reps, parts, sizes, planes = groups[order], reps[order], parts[order], sizes[order].astype(np.int64), planes[order]
    odd = None if odd is None else odd[order]
    unshared = sizes * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9  # summed for a similar pair, no fewer than its shingles that are not shared
    half = planes.shape[1] // 2
    n, links, sets = len(reps), [], _Sets(lambda row: set_of(order[row]))
    # In a group rows ascend by size: those that may be similar to a row stand right behind it.
    _, number = np.unique(groups, return_inverse=True)
    start = np.searchsorted(number, np.arange(number[-1] + 2)) if n else np.zeros(1, np.int64)
    key = number.astype(np.int64) << 40 | sizes
    reach = np.searchsorted(key, number.astype(np.int64) << 40 | (sizes / SIMILAR + 1e-9).astype(np.int64), side="right") - 1 - np.arange(n)
    _, label = np.unique(np.stack([number, parts]), axis=1, return_inverse=True)
    label = label.reshape(-1)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        new = label[a] != label[b]
        a, b = a[new], b[new]
        if not len(a):
            return
        sets.add(np.unique(np.concatenate([a, b])))
        common = sets.common(a, b)
        near = common >= SIMILAR * (sizes[a] + sizes[b] - common)
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if label[x] != label[y]:
                links.append((int(reps[x]), int(reps[y])))
                own = slice(start[number[x]], start[number[x] + 1])
                label[own][label[own] == label[y]] = label[x]

    k, active, held, size = 1, np.flatnonzero(reach >= 1), [], 0
    while len(active):
        a = active[label[active] != label[active + k]]
        if odd is not None:
            a = a[_bits(odd.take(a, axis=0) ^ odd.take(a + k, axis=0)) <= unshared[a] + unshared[a + k]]
        differ = planes.take(a, axis=0) ^ planes.take(a + k, axis=0)
        a = a[np.bitwise_count(differ[:, :half] | differ[:, half:]).sum(axis=1, dtype=np.int64) <= APART]
        held.append((a, a + k))
        size += len(held[-1][0])
        if size >= batch or k in (1, 8, 64):  # early rounds connect what is alike, which spares the later ones
            compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
        k += 1
        active = active[reach[active] >= k]
    if held:
        compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, rep, part, n_shingles, signature, tokens) in the order of their groups; a group may go on in the next batch."""

    def out(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        tokens = t.column("tokens")
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint64).reshape(-1, VALUES // 32 + PARITIES // 64)
        set_of = lambda row: shingles_of(np.frombuffer(zlib.decompress(tokens[int(row)].as_py()), np.uint8))
        links = links_within(group, *(t.column(c).to_numpy() for c in ("rep", "part", "n_shingles")), sig[:, : VALUES // 32], set_of, odd=sig[:, VALUES // 32 :])
        pairs = np.array(sorted({(min(p), max(p)) for p in links}), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.concat_tables([*held, pa.Table.from_batches([b])])
        keys = np.stack([t.column(c).to_numpy() for c in ("band", "i", "j")])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield out(t.slice(0, last), np.cumsum(new)[:last])
        held = [t.slice(last)]
    if held:
        yield out(held[0], np.zeros(held[0].num_rows, np.int64))


def _similar(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y): links inside groups. met: band, i, j (the group), rep, part; sets: rep, n_shingles, signature, tokens."""
    rows = met.join(sets, "rep").select("band", "i", "j", "rep", "part", "n_shingles", "signature", "tokens")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep").mapInArrow(_links, "x long, y long").distinct()


def file_families(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Sketches of source files with the family each belongs to.

    files: doc_id, project, text, ending. Files with equal sets of masked shingles form one class;
    classes whose sets have a Jaccard similarity of SIMILAR or more are linked, and linked classes form a family.

    All pairs that meet in a band count, however many meet there, but a pair whose ends are connected
    already is not compared. Crowds of more than BLOCK classes are first compared block by block, each
    with the crowd's first class; blocks are then compared with each other if the crowd is not
    connected by that, so that copies of one template cost no more than their number.
    """
    sketch = scratch.keep(files.select("doc_id", "project", "text", "ending").mapInArrow(_sketch, _SKETCH))
    classes = scratch.keep(sketch.groupBy("same").agg(F.min("doc_id").alias("rep")))
    reps = sketch.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0")
    bands = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    crowds = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = scratch.keep(bands.join(crowds, "band").select("band", "rep", "head", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("i")))
    asked = met.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.keep(keyed(reps, scratch.keep(asked), ["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature", "tokens"))
    own = met.withColumn("j", F.col("i"))
    heads = met.where("blocks > 1").where("rep = head").select("band", "rep", "head", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "i").where("i <> j").select("band", F.col("rep"), F.col("j").alias("i"), "j")
    first = own.select("band", "i", "j", "rep").unionByName(heads).withColumn("part", F.col("rep"))
    links = scratch.keep(_similar(first, sets))
    wide = met.where("blocks > 1")
    if wide.limit(1).count():
        root = _components(links, scratch)
        parted = wide.join(root, wide["rep"] == root["node"], "left").select("band", "blocks", "i", "rep", F.coalesce("family", "rep").alias("part"))
        split = parted.groupBy("band").agg((F.min("part") < F.max("part")).alias("split")).where("split").select("band")
        parted = parted.join(split, "band", "left_semi").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> k")
        across = parted.select("band", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), "rep", "part")
        links = scratch.keep(links.unionByName(_similar(across, sets)))
    root = _components(links, scratch)
    member = classes.join(root, classes["rep"] == root["node"], "left").select("same", F.coalesce("family", "rep").alias("family"))
    return sketch.drop("bands", "signature", "tokens").join(member, "same")


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, family): connected components by rounds of the smallest neighbour, family = smallest node."""
    both = scratch.keep(links.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("other"))).distinct())
    label = scratch.keep(both.select("node", F.col("node").alias("family")).distinct())
    while True:
        seen = both.join(label.select(F.col("node").alias("other"), F.col("family").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        new = scratch.keep(label.join(seen, "node").select("node", F.least("family", "heard").alias("family"), (F.col("heard") < F.col("family")).alias("moved")))
        scratch.drop(label)
        label = new.select("node", "family")
        if not new.where("moved").limit(1).count():
            return label
        # Labels that are nodes themselves take over those nodes' labels: the distance covered doubles.
        jump = new.select(F.col("node").alias("family"), F.col("family").alias("further"))
        label = scratch.keep(label.join(jump, "family").select("node", F.col("further").alias("family")))
        scratch.drop(new)


#: A family convicts a file if so large a share of at least two others of it shows the same.
OF_FAMILY = 0.8


def _verdicts(files: DataFrame) -> DataFrame:
    """files with what their family says: by_generated, by_vendored, by_literal, and its figures.

    files: family, project, generated, vendor (own evidence), repetition, literal_share. A file itself
    is no witness in its own case. Within a repository a family counts for generation, across
    repositories for vendoring, anywhere for literals.
    """
    own = lambda c: F.col(c).cast("long")
    inside = files.groupBy("family", F.coalesce("project", F.lit("")).alias("_project")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(own("generated")).alias("_generated"), F.sum(own("vendor")).alias("_vendor"),
        F.sum("repetition").alias("_repetition"), F.sum("literal_share").alias("_literal"),
    )
    whole = inside.groupBy("family").agg(
        F.sum("_n").alias("family_files"), F.count(F.lit(1)).alias("family_projects"), F.sum("_vendor").alias("_all_vendor"),
        F.sum("_repetition").alias("_all_repetition"), F.sum("_literal").alias("_all_literal"),
    )
    told = files.withColumn("_project", F.coalesce("project", F.lit(""))).join(inside.select("family", "_project", "_n", "_generated"), ["family", "_project"]).join(whole, "family")
    most = lambda n, of: (of >= 2) & (n >= F.lit(OF_FAMILY) * of)
    many = F.col("family_files") >= 3
    generated = most(F.col("_generated") - own("generated"), F.col("_n") - 1) | many & (F.col("_all_repetition") / F.col("family_files") >= MECHANICAL)
    vendored = (F.col("family_projects") > 1) & most(F.col("_all_vendor") - own("vendor"), F.col("family_files") - 1)
    literal = many & (F.col("_all_literal") / F.col("family_files") >= LITERAL)
    return told.withColumns({"by_generated": generated, "by_vendored": vendored, "by_literal": literal})


def classify_files(documents: DataFrame, options: DataFrame) -> DataFrame:
    """Why a source file was not written by hand in its project, one row per source file.

    documents: doc_id (unique), project_path, file_path, text; options: project_path,
    include_declaration_files, additional_excluded_patterns (regular expressions, searched anywhere in file_path).
    Columns: doc_id, stated (own statement, in the head comment, of being generated), build_place,
    mechanical (masked tokens repeat throughout the file), minified, vendored (banner, or a
    third-party folder directly below the project), literal_data, declaration (not
    wanted by its project), excluded, by_generated, by_vendored, by_literal (what the file's family says),
    the family figures, and hand_written: none of these.
    NULL and empty texts are judged by their path alone; files without a project path have no place and no options.

    Method: comments are dropped and identifiers and literals masked, so files that one generator wrote
    give the same token shingles whatever names they hold. Equal sets form classes, MinHash bands propose pairs
    of classes, exact Jaccard similarity verifies them. A family then judges each of its files by the others: as
    generated if most of the file's family in the same repository is, as a third-party copy if the family spans repositories
    and most of it is one, as data if the family is made of literals. So a file is found whose own statement or
    banner was lost. A file without a family is judged by its own evidence only. Families alone, without such evidence in
    any member, convict nobody: see README.
    """
    scratch = Scratch(documents.sparkSession)
    ending = source_ending(F.col("file_path"))
    src = documents.where(ending.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("project_path").alias("project"), "file_path", F.coalesce("text", F.lit("")).alias("text"), ending.alias("ending"))
    families = file_families(src, scratch)
    opts = options.groupBy(F.col("project_path").alias("project")).agg(F.max("include_declaration_files").alias("wanted"), F.flatten(F.collect_set(F.coalesce("additional_excluded_patterns", F.array().cast("array<string>")))).alias("patterns"))
    below = F.when(F.startswith(F.col("file_path"), F.concat("project", F.lit("/"))), F.expr("substr(file_path, length(project) + 2)"))
    under = lambda places: F.coalesce(below.rlike("^(?:" + "|".join(re.escape(p) for p in places) + ")/"), F.lit(False))
    place = under(BUILD_PLACES) | F.coalesce(below.rlike("(^|/)(?:build/generated|target/generated(-[a-z]+)?-sources|generated-sources)/"), F.lit(False))
    paths = src.join(opts, "project", "left").select(
        "doc_id", place.alias("build_place"), under(VENDOR_PLACES).alias("vendor_place"),
        (F.col("file_path").rlike(r"\.d\.[mc]?ts$") & ~F.coalesce("wanted", F.lit(False))).alias("declaration"),
        F.coalesce(F.exists("patterns", lambda p: F.regexp_like(F.col("file_path"), p)), F.lit(False)).alias("excluded"),
    )
    files = paths.join(families, "doc_id").withColumns({
        "generated": F.col("stated") | F.col("build_place") | (F.col("repetition") >= MECHANICAL),
        "vendor": F.col("banner") | F.col("vendor_place"),
    })
    out = _verdicts(files).select(
        "doc_id", "stated", "build_place", (F.col("repetition") >= MECHANICAL).alias("mechanical"), "minified", F.col("vendor").alias("vendored"),
        (F.col("literal_share") >= LITERAL).alias("literal_data"), "declaration", "excluded",
        "by_generated", "by_vendored", "by_literal", "family", "family_files", "family_projects",
    )
    reasons = ("stated", "build_place", "mechanical", "minified", "vendored", "literal_data", "declaration", "excluded", "by_generated", "by_vendored", "by_literal")
    return out.withColumn("hand_written", ~F.greatest(*reasons))
