"""Source files that are not valid in the language of their file name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {
    "kotlin": ("kt", "kts"), "java": ("java",), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"),
}
OF_ENDING = {e: lang for lang, endings in LANGUAGES.items() for e in endings}

_IDENT = r"[^\W\d][\w$]*|\$[\w$]*"
_NUMBER = r"0[xXbB][\da-fA-F_]+[uUlLn]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[\w]*|\.\d+\w*"
_SHARED = rf"(?P<blank>\s+)|(?P<line>//[^\n\r]*)|(?P<block>/\*)|(?P<id>{_IDENT})|(?P<num>{_NUMBER})"
_MARKER = r"(?P<marker>(?:<{7}|>{7}|\|{7})(?= |\r?\n|\Z)|={7}(?=\r?\n|\Z))"
_OPS = r"(?P<op>\?\.|\?:|\?\?=?|=>|->|::|\.\.\.?<?|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[{}()\[\];,.:?<>=+\-*/%!&|^~@#\\])"

_TOKENS = {
    "kotlin": re.compile(rf'{_MARKER}|{_SHARED}|(?P<raw>""")|(?P<str>")|(?P<chr>\'(?:\\u[\da-fA-F]{{4}}|\\.|[^\'\\\n\r])\')|(?P<tick>`[^`\n\r]+`)|{_OPS}|(?P<bad>.)', re.S),
    "java": re.compile(rf'{_MARKER}|{_SHARED}|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n\r]|\\.)*")|(?P<chr>\'(?:\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.|[^\'\\\n\r])\')|{_OPS}|(?P<bad>.)', re.S),
    "javascript": re.compile(rf"{_MARKER}|{_SHARED}|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')|(?P<tpl>`)|(?P<private>\#{_IDENT})|{_OPS}|(?P<bad>.)", re.S),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_KOTLIN_BLOCK = re.compile(r"/\*|\*/")
_KOTLIN_STRING = re.compile(r'\\.|\$\{|"|[\n\r]', re.S)
_KOTLIN_RAW = re.compile(r'"{3,}|\$\{')
_TEMPLATE = re.compile(r"\\.|\$\{|`", re.S)
_REGEX = re.compile(r"/(?:[^/\\\n\r\[]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = set(_OPEN.values())
#: After these words a slash begins a regular expression, as it does after an operator.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


class Invalid(Exception):
    """The reason a text is not valid."""


def tokens(text: str, language: str) -> list[tuple[str, str, int]]:
    """(kind, text, nesting) of every token but blanks and comments; kind nl at line ends. Raises Invalid.

    A pushdown stack holds the open brackets and the strings whose templates are open.
    """
    pattern, out, stack, i, n = _TOKENS[language], [], [], 0, len(text)
    script = language in ("javascript", "typescript")

    def template(at: int, quote: str) -> int:
        """Reads on in a template string; at its end, or at an expression in it, gives the place after it."""
        ends = _TEMPLATE if quote == "`" else _KOTLIN_RAW if quote == '"""' else _KOTLIN_STRING
        while True:
            m = ends.search(text, at)
            if not m or m[0] in "\n\r" and quote == '"':
                raise Invalid("unterminated literal")
            at = m.end()
            if m[0] == "${":
                stack.append(quote)
                out.append(("op", "{", len(stack)))
                return at
            if m[0][0] == quote[0] and m[0][0] != "\\":
                return at

    while i < n:
        m = pattern.match(text, i)
        kind, tok = m.lastgroup, m[0]
        i = m.end()
        if kind == "blank":
            if "\n" in tok or "\r" in tok:
                out.append(("nl", "", len(stack)))
            continue
        if kind == "line":
            continue
        if kind == "block":
            if language == "kotlin":
                depth = 1
                while depth:
                    c = _KOTLIN_BLOCK.search(text, i)
                    if not c:
                        raise Invalid("unterminated comment")
                    depth += 1 if c[0] == "/*" else -1
                    i = c.end()
            else:
                i = text.find("*/", i) + 2
                if i < 2:
                    raise Invalid("unterminated comment")
            continue
        if kind == "marker":
            if m.start() == 0 or text[m.start() - 1] in "\n\r":
                raise Invalid("merge conflict")
            kind, tok, i = "op", tok[0], m.start() + 1
        if kind == "bad":
            raise Invalid("unterminated literal" if tok in "\"'`" else "unexpected character")
        if kind == "op":
            if tok in _OPEN:
                stack.append(_OPEN[tok])
            elif tok in _CLOSE:
                if not stack:
                    raise Invalid("unbalanced delimiter")
                top = stack.pop()
                if top in ('"', '"""', "`"):
                    if tok != "}":
                        raise Invalid("unbalanced delimiter")
                    out.append(("op", "}", len(stack) + 1))
                    i = template(i, top)
                    continue
                if top != tok:
                    raise Invalid("unbalanced delimiter")
            elif script and tok in ("/", "/="):
                last = next((t for t in reversed(out) if t[0] != "nl"), None)
                if last is None or last[0] == "op" and last[1] not in (")", "]", "}") or last[0] == "id" and last[1] in _BEFORE_REGEX:
                    r = _REGEX.match(text, m.start())
                    if r:
                        out.append(("str", "", len(stack)))
                        i = r.end()
                        continue
        elif kind in ("raw", "tpl") or kind == "str" and language == "kotlin":
            out.append(("str", "", len(stack)))
            i = template(i, tok)
            continue
        out.append((kind, tok, len(stack)))
    if stack:
        raise Invalid("premature end")
    return out


_W = str.split
#: Words that may stand before another name on the same line.
_LEADING = {
    "javascript": set(_W("const let var function class extends return typeof new throw case in of instanceof async await export default import from as static get set yield delete void else do continue break if for while switch try finally")),
    "kotlin": set(_W("fun val var class interface object package import return throw in is as if else when while for do try catch finally by where constructor init get set typealias out dynamic")),
}
_LEADING["typescript"] = _LEADING["javascript"] | set(_W("interface type enum namespace module declare abstract readonly private public protected is keyof infer unique asserts satisfies override accessor implements global out"))
_KOTLIN_MODIFIERS = set(_W("public private protected internal override open abstract final sealed data enum annotation inner companion const lateinit suspend inline infix operator tailrec external vararg noinline crossinline reified value expect actual"))
_FOREIGN = {
    "kotlin": set(_W("function def let export extends implements void static elif lambda from")),
    "java": set(_W("fun val def function const let export elif lambda")),
}
_SCRIPT_ONLY_TS = set(_W("interface namespace declare abstract readonly private public protected implements enum"))
_END_OK = {";", "}", ")", "]", "++", "--", ">", "!", "!!"}


def _check_adjacent(ts: list, language: str) -> None:
    """Two names beside each other on a line, which no grammar allows but after certain words."""
    lead = _LEADING[language] | (_KOTLIN_MODIFIERS if language == "kotlin" else set())
    for k in range(len(ts) - 1):
        (a, x, _), (b, y, _) = ts[k], ts[k + 1]
        if b not in ("id", "num", "str") or a not in ("id", "num"):
            continue
        if language == "kotlin":
            if a == "id" and x in _KOTLIN_MODIFIERS:
                if b == "id" and y not in _LEADING["kotlin"] and y not in _KOTLIN_MODIFIERS:
                    raise Invalid("written in another language")
                continue
            if a == "id" and x in _FOREIGN["kotlin"]:
                raise Invalid("written in another language")
            if x in lead or y in ("in", "is", "as", "by", "else", "where", "get", "set", "constructor") or b != "id":
                if b != "id" and x not in lead and not (k and ts[k - 1][0] in ("id", "num", "str", "op") and ts[k - 1][1] not in ("(", ",", "=", "{")):
                    raise Invalid("written in another language")
                continue
            # An infix call has an operand on both sides.
            after = ts[k + 2] if k + 2 < len(ts) else ("nl", "", 0)
            before = ts[k - 1] if k else ("nl", "", 0)
            infix = after[0] in ("id", "num", "str", "chr", "raw") or after[1] in ("(", "{", "[", "-", "!")
            second = before[0] in ("id", "num", "str") or before[1] in (")", "]")  # y is the operand behind the infix name x
            if not infix and not second:
                raise Invalid("written in another language")
        elif a == "id" and x in lead or b == "id" and y in ("in", "of", "instanceof", "as", "extends", "implements", "from", "is", "satisfies", "else", "while", "catch", "finally", "keyof"):
            continue
        else:
            raise Invalid("written in another language")


def _check_script(ts: list, language: str) -> None:
    solid = [t for t in ts if t[0] != "nl"]
    _check_adjacent(ts, language)
    for k, (kind, tok, _) in enumerate(solid):
        nxt = solid[k + 1] if k + 1 < len(solid) else ("nl", "", 0)
        prev = solid[k - 1] if k else ("nl", "", 0)
        if kind == "op" and tok == "=" and nxt[1] in ("=", ";", ")", "}", "]"):
            raise Invalid("unexpected token")
        if kind == "op" and tok in ("#", "::", "@") and (tok != "@" or language == "javascript"):
            raise Invalid("written in another language")
        if kind == "op" and tok == "<" and nxt[1] == "!":
            raise Invalid("written in another language")
        if kind == "id" and tok == "import" and prev[1] != "." and not (nxt[0] in ("str", "id") or nxt[1] in ("{", "*", "(", ".")):
            raise Invalid("unexpected token")
        if kind == "id" and tok == "import" and nxt[0] == "id" and prev[1] not in (".", "?.") and nxt[1] not in ("type", "typeof", "defer"):
            after = solid[k + 2] if k + 2 < len(solid) else ("nl", "", 0)
            if after[1] not in ("from", ",", "="):
                raise Invalid("written in another language")
        if kind == "id" and tok == "class" and prev[1] != "." and nxt[0] == "id" and nxt[1] != "extends":
            after = solid[k + 2] if k + 2 < len(solid) else ("nl", "", 0)
            if after[1] not in ("{", "extends", "implements", "<"):
                raise Invalid("written in another language")
    if language == "javascript":
        _check_plain_script(solid)


def _check_plain_script(solid: list) -> None:
    """JavaScript has no type annotations, member modifiers or type declarations."""
    frames: list[str] = []  # what an open bracket belongs to
    ternaries = [0]
    for k, (kind, tok, _) in enumerate(solid):
        nxt = solid[k + 1] if k + 1 < len(solid) else ("nl", "", 0)
        prev = solid[k - 1] if k else ("nl", "", 0)
        if kind == "id" and nxt[0] == "id" and prev[1] not in (".", "?."):
            if tok in _SCRIPT_ONLY_TS and nxt[1] not in ("in", "of", "instanceof"):
                raise Invalid("type annotations")
            after = solid[k + 2] if k + 2 < len(solid) else ("nl", "", 0)
            if tok == "type" and after[1] in ("=", "<") or tok in ("as", "satisfies") and prev[0] in ("id", "str", "num") and not (frames and frames[-1] == "{names"):
                if tok == "type" or not any(t[1] in ("import", "export") for t in solid[max(0, k - 6) : k]):
                    raise Invalid("type annotations")
        if kind != "op":
            continue
        if tok in ("(", "[", "{"):
            if tok == "(":
                frames.append("(")
            elif tok == "{":
                frames.append("{names" if prev[1] in ("import", "export", ",") and any(t[1] in ("import", "export") for t in solid[max(0, k - 4) : k]) else "{")
            else:
                frames.append("[")
            ternaries.append(0)
        elif tok in (")", "]", "}"):
            if frames:
                frames.pop()
            if len(ternaries) > 1:
                ternaries.pop()
        elif tok == "?":
            if nxt[1] in (":", ")", ","):
                raise Invalid("type annotations")
            ternaries[-1] += 1
        elif tok == ":":
            if ternaries[-1]:
                ternaries[-1] -= 1
            elif prev[1] == ")" or frames and frames[-1] in ("(", "["):
                raise Invalid("type annotations")
            elif not frames and prev[0] == "id" and (k < 2 or solid[k - 2][1] in ("const", "let", "var")):
                raise Invalid("type annotations")
            elif k > 1 and solid[k - 2][1] in ("const", "let", "var"):
                raise Invalid("type annotations")


def _check_java(ts: list) -> None:
    solid = [t for t in ts if t[0] != "nl"]
    ternaries = [0]
    for k, (kind, tok, _) in enumerate(solid):
        nxt = solid[k + 1] if k + 1 < len(solid) else ("nl", "", 0)
        prev = solid[k - 1] if k else ("nl", "", 0)
        if kind == "op" and tok == "=" and nxt[1] in ("=", ";", ")", "}", "]"):
            raise Invalid("unexpected token")
        if kind == "op" and tok in ("#", "===", "!==", "=>", "?.", "?:", "??", "\\"):
            raise Invalid("written in another language")
        if kind == "op" and tok == "<" and (nxt[1] == "!" or not k):
            raise Invalid("written in another language")
        if kind == "id" and tok in ("package", "import") and prev[1] != ".":
            j = k + 1
            if j < len(solid) and solid[j][1] == "static":
                j += 1
            while j < len(solid) and (solid[j][0] == "id" or solid[j][1] in (".", "*")) and (solid[j][1] == "." or solid[j - 1][1] == "." or j == k + 1 or solid[j - 1][1] == "static"):
                j += 1
            if j >= len(solid) or solid[j][1] != ";" or j == k + 1:
                raise Invalid("written in another language")
        if kind == "id" and prev[1] not in (".", "?.", "::"):
            if tok in _FOREIGN["java"] and nxt[0] == "id":
                raise Invalid("written in another language")
            if tok in ("class", "interface", "enum") and nxt[0] == "id" and prev[1] != "@":
                after = solid[k + 2] if k + 2 < len(solid) else ("nl", "", 0)
                if after[1] not in ("{", "<", "extends", "implements", "permits"):
                    raise Invalid("written in another language")


def _check_kotlin(ts: list) -> None:
    solid = [t for t in ts if t[0] != "nl"]
    _check_adjacent(ts, "kotlin")
    for k, (kind, tok, _) in enumerate(solid):
        nxt = solid[k + 1] if k + 1 < len(solid) else ("nl", "", 0)
        if kind == "op" and tok == "=" and nxt[1] in ("=", ";", ")", "}", "]"):
            raise Invalid("unexpected token")
        if kind == "op" and tok in ("#", "=>", "\\"):
            raise Invalid("written in another language")
        if kind == "op" and tok == "<" and (nxt[1] == "!" or not k):
            raise Invalid("written in another language")
        if kind == "id" and tok == "import" and nxt[0] not in ("id", "tick"):
            raise Invalid("written in another language")


def fault(text: str | None, ending: str) -> str | None:
    """Why a text is not valid in the language of its file's ending, or None."""
    language = OF_ENDING[ending]
    if not text:
        return None
    text = text.removeprefix("﻿")
    if text.startswith("#!") and language != "java":
        text = "//" + text[2:]
    try:
        ts = tokens(text, language)
        last = next((t for t in reversed(ts) if t[0] != "nl"), None)
        if language == "java":
            _check_java(ts)
        elif language == "kotlin":
            _check_kotlin(ts)
        else:
            _check_script(ts, language)
        if last and last[0] == "op" and last[1] not in _END_OK and not (language == "kotlin" and last[1] in ("*", "?")):
            raise Invalid("premature end")
        if language == "java" and last and last[1] not in (";", "}"):
            raise Invalid("premature end")
    except Invalid as e:
        return str(e)
    return None


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        why = [fault(t, e) for e, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(why, pa.string())], [batch.schema.names[0], *batch.schema.names[3:], "fault"])


def source_ending(path: Column) -> Column:
    """The ending of a source file, in lower case, or NULL."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1))
    return F.when(ending.isin(sorted(OF_ENDING)), ending)


def language_of(ending: Column) -> Column:
    """Language of a file ending."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(OF_ENDING.items()) for x in pair]), ending)


def parse_faults(documents: DataFrame) -> DataFrame:
    """(doc_id, project_path, file_path, language, fault) of every source file; fault is NULL for a valid one.

    documents: doc_id, project_path, file_path, text. The ending of file_path fixes the language;
    other files and NULL paths give no row. NULL and empty texts are valid. fault is one of merge
    conflict, unterminated literal, unterminated comment, unbalanced delimiter, premature end, unexpected character,
    unexpected token, type annotations, written in another language. Repeated rows give a row each.

    Method: a lexer per language with a pushdown stack of open brackets and string templates finds
    unterminated literals, unbalanced delimiters, premature ends and merge-conflict markers, all of
    them outside strings and comments only; the token stream then shows words and marks that the
    language does not have. A file is read once, in its own task; nothing is shuffled.
    """
    ending = source_ending(F.col("file_path"))
    rows = documents.select("doc_id", ending.alias("ending"), "text", "project_path", "file_path", language_of(ending).alias("language")).where("ending is not null")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_faults, f"doc_id {id_type}, project_path string, file_path string, language string, fault string")


def fault_rates(documents: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """(project_path, language, n_files, n_invalid, rate, n_reported): invalid source files, and how many of those parse_errors names.

    A file is reported if any of its rows in parse_errors has its path, whatever the error says.
    """
    f = parse_faults(documents)
    reported = parse_errors.where("file_path is not null").select("file_path", F.lit(1).alias("seen")).distinct()
    bad = F.col("fault").isNotNull().cast("long")
    return (
        f.join(reported, "file_path", "left").groupBy("project_path", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum(bad).alias("n_invalid"), F.sum(F.when(F.col("seen") == 1, bad).otherwise(0)).alias("n_reported"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
