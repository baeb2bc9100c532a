"""Credentials embedded in source code and configuration."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.syntax import source_ending
from graphloom.session import Scratch, keyed

#: Characters of a chunk of the index. What a rule must hold lies within so many characters of its match's beginning.
CHUNK = 1 << 16

_SECRET_NAME = (
    r"(?:(?<![A-Za-z])|(?<=[a-z_\d])(?=[A-Z])|(?<=[A-Z])(?<!COM)(?=[A-Z]{3,}))"
    r"(?P<name>(?i:passwords?|passwd|passphrase|pass|pwd|secrets?|tokens?|credentials?|(?:api|access|signing|encryption|hmac|licen[cs]e|private|secret|master|auth|shared|storage|account|session)[_-]?key))"
)
_IS = r"""["'`]?\]?(?:[ \t]*:[ \t]*[\w.<>?\[\] |]+=(?!=)|[ \t]*=(?!=)>?|[ \t]*:(?!:)|[ \t]+(?:to|is)(?=[ \t]))(?:[ \t]*[\r\n]+[ \t]*(?=["'`]))?[ \t]*"""

#: Detection rules: name -> regular expression. The group `v` holds the secret. Without it the secret is looked for
#: behind the match: in the rest of the statement, or for a private key up to its end line.
RULES = {
    "aws_key": r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9])",
    "github": r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{36,})",
    "github_fine": r"(?P<v>github_pat_[A-Za-z0-9_]{40,})",
    "gitlab": r"(?<![A-Za-z0-9])(?P<v>glpat-[A-Za-z0-9_-]{20,})",
    "slack": r"(?<![A-Za-z0-9])(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})",
    "npm": r"(?<![A-Za-z0-9])(?P<v>npm_[A-Za-z0-9]{36})",
    "stripe": r"(?<![A-Za-z0-9])(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})",
    "google": r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{35})",
    "sendgrid": r"(?<![A-Za-z0-9])(?P<v>SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})",
    "jwt": r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})",
    "bearer": r"(?i:bearer)\s+(?P<v>[A-Za-z0-9._~+/-]{20,}=*)",
    "basic": r"(?i:basic)\s+(?P<v>[A-Za-z0-9+/]{10,}={0,2})(?![A-Za-z0-9+/=])",
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "url": r"(?<=[A-Za-z0-9+.-])://[^\s:/@\"'`<>]*:(?P<v>[^\s@/\"'`]{3,})@",
    "parameter": r"[?&;](?i:password|passwd|pwd|passphrase|secret|token|access_token|api_?key|client_secret|sig)=(?P<v>[^&\s\"'`;<]+)",
    "lookup": r"(?i:env|property)[\[(.\"'\s]+\w*(?i:password|passwd|pwd|passphrase|secret|token|key)[\"'\])\s]*(?:\?:|\|\||\?\?|,)\s*(?=[\"'`])",
    "assigned_pass": rf"{_SECRET_NAME}{_IS}(?=[^\n\r])",
}

#: Values that stand for a value: wholly a mask, a lookup, or words that say so, with a short number at most.
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:<.*>?|\$\{?.*|\{\{.*|%\w+%|@\w+@|[*x.•#_-]+|none|null|undefined|nil|true|false|(?:vault|env|ref|arn|file):.*|secretref.*|kv/.*"
    r"|(?:todo|fixme|change.?me|replace.?me|your|example|placeholder|dummy|sample|redacted|not.?set)[a-z_. -]*\d{0,4})\Z"
)
_PATTERN = re.compile(r"\[[^\]]+\]|\\[dwsDWS]|\(\?|\{\d+,?\d*\}|\.[*+]")
_QUOTED = re.compile(r'"""(.*?)"""|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`]*)`', re.S)
_LOOKUP_CALL = re.compile(r"(?i)(?:getenv|getproperty|env|environ|read|lookup|resolve|fetch\w*|load\w*|find\w*|get|getstring|getsecret|config|property|header)\s*[(\[]\s*\Z")
_TICKED = re.compile(r"`([^`\n]+)`")
_BARE = re.compile(r"[^\s\"'`,;]+")
#: What may end a statement or begin a literal.
_NEXT = re.compile(r"[\"'`;,\n\r()\[\]{}]")
_GOES_ON = re.compile(r"\s*\+")
#: Embedded data, by form: Base64 of a known file format or of a public key or certificate, or Base64 too long for a key without a form of its own.
_DATA = re.compile(r"(?:iVBORw0KGgo|R0lGOD|/9j/|JVBERi|UEsDB|H4sIA|d09GM|AAABAA|PHN2Zy|MII[A-Za-z0-9])[A-Za-z0-9+/]{40,}={0,2}|(?=.*[+/])[A-Za-z0-9+/]{200,}={0,2}")
_HUMAN_NAMES = ("password", "passwd", "passphrase", "pass", "pwd")
_COMPILED: dict[str, re.Pattern] = {}


def _rule(name: str) -> re.Pattern:
    if name not in _COMPILED:
        _COMPILED[name] = re.compile(RULES[name], re.S)
    return _COMPILED[name]


def _private_der(v: str) -> bool:
    """Whether text is Base64 of a private key: a DER sequence that begins with version 0 or 1, as public keys and certificates do not."""
    try:
        head = base64.b64decode(v[:16], validate=True)
    except (binascii.Error, ValueError):
        return False
    return bool(re.match(rb"\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...)\x02\x01[\x00\x01]", head, re.S)) and bool(re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v))


def _no_word(v: str) -> bool:
    """Whether small letters make no word: hardly a vowel, or six consonants in a row."""
    return len(v) >= 8 and (len(re.findall("[aeiouy]", v)) * 6 < len(v) or bool(re.search("[^aeiouy]{6}", v)))


def usable(value: str, name: str = "") -> bool:
    """Whether text can be a secret rather than a name, a placeholder, a mask, a route, a pattern or embedded data.

    name: the word that calls it a secret, if any; only a password may be digits alone. The whole value decides, however long.
    """
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.match(v) or len(set(v)) < 4:
        return False
    if _DATA.fullmatch(v) and not _private_der(v):
        return False
    if "://" in v or v.startswith(("/", "data:", "--")) or _PATTERN.search(v) or "BEGIN" in v and "KEY" in v:
        return False
    if not re.search(r"[A-Za-z]", v):
        return v.isdigit() and name.lower().rstrip("s") in _HUMAN_NAMES
    if re.search(r"\d", v):
        return True
    if not (re.search(r"[a-z]", v) and re.search(r"[A-Z]", v)):
        return v.isalpha() and _no_word(v.lower())
    # Without a digit: a mark among the letters, or capitals where no word of a name has them.
    return bool(re.search(r"[^\w.,:/-]", v)) or len(v) >= 8 and v.isalpha() and not re.fullmatch(r"[A-Za-z][a-z]{2,}(?:[A-Z][a-z]{2,})*", v)


def _decoded(v: str) -> str:
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return ""


def _literals(text: str, at: int, bare: bool) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(value, places) of the literals in the statement that goes on at `at`; literals joined by + make one value.

    The statement ends, wherever that is, at a semicolon, a comma outside brackets, a bracket that was opened before it,
    or a line's end unless a + stands at it.
    """
    pieces: list[tuple[str, int, int, str]] = []
    begun = end = pos = at
    depth = 0
    while m := _NEXT.search(text, pos):
        c, pos = m[0], m.end()
        if c in "\"'`":
            q = _QUOTED.match(text, m.start())
            if q:
                g = next(i for i in range(1, 5) if q[i] is not None)
                pieces.append((q[g], q.start(g), q.end(g), text[end : q.start()]))
                end = pos = q.end()
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                break
        elif c == ",":
            if not depth:
                break
        elif c == ";" or not (text[end : m.start()].rstrip().endswith("+") or _GOES_ON.match(text, pos)):
            break
    k = 0
    while k < len(pieces):
        value, places = pieces[k][0], [pieces[k][1:3]]
        looked_up = bool(_LOOKUP_CALL.search(pieces[k][3]))
        while k + 1 < len(pieces) and re.fullmatch(r"\s*\+\s*", pieces[k + 1][3]):
            k += 1
            value += pieces[k][0]
            places.append(pieces[k][1:3])
        if not looked_up:
            yield value, places
        k += 1
    if bare and not text.startswith(("\"", "'", "`"), begun):
        m = _BARE.match(text, begun)
        if m and not re.search(r"[()]", m[0]):  # code, as in a call or a list of parameters
            yield m[0], [m.span()]
    elif bare:
        m = _TICKED.match(text, begun)
        if m:
            yield m[1], [m.span(1)]


def secrets_in(text: str, rules: dict[str, int] | list[str], source: bool) -> list[tuple[int, int, str]]:
    """(start, end, rule) of every secret that the given rules find; source: only quoted literals count after names.

    rules: the rules to try, or each with the place from which it is tried. Names, look-behinds and values are read
    from the whole text.
    """
    found = []
    for name in rules:
        for m in _rule(name).finditer(text, rules[name] if isinstance(rules, dict) else 0):
            if name in ("lookup", "assigned_pass"):
                called = m["name"] if name == "assigned_pass" else ""
                if called and source and re.search(r"(?:==|!=|[,(]\s*)\Z", m[0]):
                    continue
                for value, places in _literals(text, m.end(), not source and bool(called)):
                    if usable(value, called):
                        found += [(a, b, name) for a, b in places if b > a]
                continue
            if name == "private_key":
                stop = text.find("-----END ", m.end())
                v = text[m.end() : stop]
                if stop > 0 and "PRIVATE KEY" not in v and len(re.findall(r"[A-Za-z0-9+/]", v.replace("\\n", "\n"))) >= 40:
                    found.append((m.end(), stop, name))
                continue
            v = m["v"]
            if name == "basic":
                d = _decoded(v)
                ok = ":" in d and d.isprintable() and usable(d.split(":", 1)[1])
            elif name in ("url", "parameter"):
                ok = usable(v)
            elif name == "bearer":
                ok = bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) and not _PLACEHOLDER.match(v)
            else:
                ok = len(set(v)) > 6
            if ok:
                found.append((m.start("v"), m.end("v"), name))
    return found


# ---- required trigrams ----


def required_trigrams(pattern: str, limit: int = 256) -> list[frozenset[str]]:
    """Sets of lower-case trigrams of which every match of a regular expression holds one whole set.

    From the parsed expression: literal characters that stand beside each other in every match
    give trigrams, alternatives give a set each. An expression without any gives one empty set,
    which every text holds. Beyond `limit` alternatives a part counts as unknown, so that a set is never too strict.
    Nothing is asked of what follows a part without bound, so all of a set lies within CHUNK characters of the match's beginning.
    """
    from re import _constants as C
    from re import _parser

    def walk(tree) -> list[tuple[str, ...]]:
        """Alternatives of one part: runs of literals; an empty run marks something unknown."""
        alts: list[tuple[str, ...]] = [("",)]
        width = 0
        for item in tree:
            op, arg = item
            if width >= CHUNK // 2:
                break
            width += _parser.SubPattern(tree.state, [item]).getwidth()[1]
            if op is C.LITERAL:
                part = [(chr(arg).lower(),)]
            elif op is C.SUBPATTERN:
                part = walk(arg[3])
            elif op is C.BRANCH:
                part = [a for branch in arg[1] for a in walk(branch)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                one = walk(inner)
                part = one if low == high == 1 else [(*a, "") if len(a) > 1 else (a[0], "", a[0]) for a in one] if low else [("", "")]
                if low == 0 and high == 1 and len(one) <= 4:
                    part = [*one, ("",)]
            elif op is C.IN and len(arg) <= 6 and all(o is C.LITERAL for o, _ in arg):
                part = [(x,) for x in sorted({chr(v).lower() for _, v in arg})]
            elif op in (C.ASSERT, C.ASSERT_NOT, C.AT):
                continue
            else:
                part = [("", "")]
            if len(part) * len(alts) > limit:
                part = [("", "")]
            alts = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(alts, part)))
        return alts

    sets = {frozenset(r[i : i + 3] for r in a for i in range(len(r) - 2)) for a in walk(_parser.parse(pattern, re.S))}
    if frozenset() in sets:
        return [frozenset()]
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _plan() -> tuple[list[str], list[tuple[str, list[int]]]]:
    """All trigrams that some rule asks for, and (rule, numbers of its trigrams) for every alternative."""
    needs = [(name, s) for name, pattern in RULES.items() for s in required_trigrams(pattern)]
    grams = sorted({g for _, s in needs for g in s})
    number = {g: i for i, g in enumerate(grams)}
    return grams, [(name, sorted(number[g] for g in s)) for name, s in needs]


def _index(grams: list[str]):
    table_codes = [int.from_bytes(g.encode("latin-1", "replace"), "big") for g in grams]

    def postings(b: np.ndarray, table: np.ndarray) -> list[int]:
        hit = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]] if len(b) > 2 else np.empty(0, np.int16)
        return np.flatnonzero(np.bincount(hit[hit >= 0], minlength=1)).tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << 24, -1, np.int16)
        table[table_codes] = np.arange(len(table_codes))
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            posts = []
            for text in batch.column(2).to_pylist():
                b = np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8).astype(np.int32)
                # Lower-casing may lengthen a text by a few characters: a chunk reads on so far.
                posts.append([postings(b[at : at + 2 * CHUNK + len(b) - len(text)], table) for at in range(0, max(1, len(text)), CHUNK)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(posts, kind)], ["src_table", "row_id", "text", "source", "chunks"])

    return work


def trigram_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(src_table, row_id, text, source, chunks): which of the given trigrams every chunk of a text holds.

    rows: src_table, row_id, text, source. chunks has the numbers of the trigrams in characters
    i * CHUNK to (i + 2) * CHUNK for every i: all that a rule must hold whose match begins in the first half. NULL texts are left out.
    """
    r = rows.where("text is not null").select("src_table", F.col("row_id").cast("long").alias("row_id"), "text", "source")
    return r.mapInArrow(_index(grams), "src_table string, row_id long, text string, source boolean, chunks array<array<int>>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s, i, text, source, asked in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            rules = {name: chunk * CHUNK for chunk, names in reversed(list(enumerate(asked))) for name in names}
            out += [(s, i, a, b, r) for a, b, r in secrets_in(text, dict(sorted(rules.items())), source)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["src_table", "row_id", "start", "end", "rule"])


def candidates(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, text, source, rules): texts with at least one rule to try; rules: its names for every chunk."""
    grams, needs = _plan()

    def rules(held: Column) -> Column:
        found = [F.when(F.array_size(F.array_intersect(held, F.array(*[F.lit(g) for g in gs]))) == len(gs), F.lit(name)) if gs else F.lit(name) for name, gs in needs]
        return F.array_distinct(F.array_compact(F.array(*found)))

    every = trigram_index(rows, grams).select("src_table", "row_id", "text", "source", F.transform("chunks", rules).alias("rules"))
    return every.where(F.exists("rules", lambda r: F.size(r) > 0))


def find_secrets(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, start, end, rule): every secret in a text, by character offsets; distinct.

    rows: src_table, row_id, text, source (true: programming language, where only quoted literals
    count as values of a name; false: configuration and prose, where bare words do too). NULL and
    empty texts hold nothing; equal rows give equal results once. Neither texts nor secrets have a length limit.

    Method: trigrams that every match must hold are derived from the detection expressions. One
    pass notes for every chunk of text which of them it holds; the postings of each rule's
    trigrams are intersected chunk by chunk, so no posting list of a common trigram is ever
    gathered in one place, and expressions run only on the texts, from the chunk on, and for the rules that are
    left. Index, intersection and verification follow each other in the same task, without a
    shuffle of texts.
    """
    return candidates(rows).mapInArrow(_verified, "src_table string, row_id long, start long, end long, rule string").distinct()


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans, lead in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            out, end = [], 0
            for s in sorted((s["start"], s["end"]) for s in spans):
                if s[0] >= end:
                    out += [text[end : s[0]], "REDACTED"]
                end = max(end, s[1])
            texts.append(("".join(out) + text[end:])[lead:])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["src_table", "row_id", "redacted"])


def redact_secrets(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, redacted): the rows of `find_secrets` with every secret replaced by REDACTED.

    rows may have a column lead: so many characters were put before the text and are taken off again.

    Only the characters of a secret change, so quotes, line ends and the code around them stay.
    Only rows with secrets are returned; row_id is unique per src_table, repeated rows give one.
    """
    on = ["src_table", "row_id"]
    scratch = Scratch(rows.sparkSession)
    spans = scratch.keep(find_secrets(rows).groupBy(*on).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    lead = F.col("lead") if "lead" in rows.columns else F.lit(0)
    texts = rows.where("text is not null").select("src_table", F.col("row_id").cast("long").alias("row_id"), "text", lead.alias("lead"))
    held = keyed(texts, spans.select(*on), on).dropDuplicates([*on, "text"])
    return held.join(spans, on).select(*on, "text", "spans", "lead").mapInArrow(_redact, "src_table string, row_id long, redacted string")


def secret_rows(properties: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows `find_secrets` reads: every property as `name = initializer`, every document as it is."""
    before = F.concat(F.coalesce("name", F.lit("_")), F.lit(" = "))
    p = properties.select(F.lit("parsed_properties").alias("src_table"), F.col("property_id").alias("row_id"), F.concat(before, "initializer").alias("text"), F.lit(True).alias("source"), F.length(before).alias("lead"))
    d = documents.select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "text", source_ending(F.col("file_path")).isNotNull().alias("source"), F.lit(0).alias("lead"))
    return p.unionByName(d)
