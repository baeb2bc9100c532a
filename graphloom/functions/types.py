"""Column expressions on type texts and fully-qualified names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names that never name a node of the graph.
BUILT_IN_TYPES = (
    # Kotlin
    "Unit", "Nothing", "Any", "Boolean", "Byte", "Short", "Int", "Long", "Float", "Double", "Char", "String", "Array", "List", "Set", "Map",
    "Collection", "Iterable", "Sequence", "Pair", "Triple", "Result", "Comparable", "Number", "Enum", "Object", "Throwable", "Exception",
    "Error", "RuntimeException",
    # TypeScript: primitive types
    "Void", "Never", "Unknown", "Undefined", "Null", "BigInt", "Symbol",
    # TypeScript: utility types
    "Partial", "Required", "Readonly", "Record", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "Parameters", "ReturnType",
    "ConstructorParameters", "InstanceType", "ThisParameterType", "OmitThisParameter", "ThisType", "Awaited", "Uppercase", "Lowercase",
    "Capitalize", "Uncapitalize", "NoInfer",
    # TypeScript: built-in objects
    "Promise", "ArrayLike", "Iterator", "IterableIterator", "AsyncIterator", "AsyncIterableIterator", "Generator", "AsyncGenerator",
    "ReadonlyArray", "ReadonlyMap", "ReadonlySet", "WeakMap", "WeakSet", "WeakRef", "Function", "Date", "RegExp", "JSON", "Math", "Proxy",
    "Reflect", "ArrayBuffer", "SharedArrayBuffer", "DataView", "Int8Array", "Uint8Array", "Uint8ClampedArray", "Int16Array", "Uint16Array",
    "Int32Array", "Uint32Array", "Float32Array", "Float64Array", "BigInt64Array", "BigUint64Array",
    # Documents and the network
    "HTMLElement", "HTMLDivElement", "HTMLInputElement", "HTMLButtonElement", "HTMLFormElement", "HTMLAnchorElement", "HTMLImageElement",
    "HTMLSpanElement", "HTMLParagraphElement", "Element", "Node", "NodeList", "Document", "Window", "Event", "MouseEvent", "KeyboardEvent",
    "CustomEvent", "EventTarget", "Response", "Request", "Headers", "URL", "URLSearchParams", "FormData", "Blob", "File", "FileReader",
    "AbortController", "AbortSignal",
)


def type_names(text: Column) -> Column:
    """Distinct names of types in a type's text, in order, without built-in ones: words that begin with a capital."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"\?", ""), F.lit(r"\b([A-Z][a-zA-Z0-9]*)\b"), 1)
    built_in = F.array(*[F.lit(t) for t in BUILT_IN_TYPES])
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(built_in, t)))


def package_of_fqn(fqn: Column) -> Column:
    """The package of a name: its last segment dropped, then closing segments that begin with a capital, at least one kept."""
    head = F.regexp_replace(fqn, r"\.[^.]+\z", "")
    return F.regexp_replace(head, r"(?:\.[A-Z][^.]*)+\z", "")


def base_type(text: Column) -> Column:
    """A type without type arguments and closing `?`."""
    return F.regexp_replace(F.btrim(F.substring_index(text, "<", 1)), r"\?\z", "")


# Number type of Kotlin -> the types it widens to.
WIDENS_TO = {
    "Byte": ["Short", "Int", "Long", "Float", "Double", "Number"],
    "Short": ["Int", "Long", "Float", "Double", "Number"],
    "Int": ["Long", "Float", "Double", "Number"],
    "Long": ["Float", "Double", "Number"],
    "Float": ["Double", "Number"],
    "Double": ["Number"],
}
# Type of TypeScript -> other types it may be assigned to, beside `any` and `unknown`.
ASSIGNABLE_TO = {
    "void": ["undefined"],
    "undefined": ["void"],
    "Array": ["ReadonlyArray"],
}
# Other types of Kotlin -> the types they may stand for.
STANDS_FOR = {
    "String": ["CharSequence"],
    "Collection": ["Iterable"],
}


def _listed(table: dict[str, list[str]], a: Column, p: Column) -> Column:
    found = [(a == k) & p.isin(v) for k, v in table.items()]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def compatible(a: Column, p: Column) -> Column:
    """`is_type_compatible` of types without type arguments and closing `?`."""
    always = (a == p) | a.isin("any", "never", "Nothing") | p.isin("any", "unknown", "Any")
    small = lambda c: F.substring(c, 1, 1) == F.lower(F.substring(c, 1, 1))
    rule = F.when(small(a) | small(p), _listed(ASSIGNABLE_TO, a, p)).otherwise(_listed(WIDENS_TO, a, p) | _listed(STANDS_FOR, a, p))
    return F.coalesce(always | rule, F.lit(False))


def is_type_compatible(argument: Column, parameter: Column) -> Column:
    """Whether a value of the argument's type may be passed for the parameter.

    A type that begins with a small letter is one of TypeScript: then only that language's assignments count. NULL counts as not.
    """
    return compatible(base_type(argument), base_type(parameter))


def overload_score(arguments: Column, parameters: Column) -> Column:
    """Score of an overload for a call: +100 for an equal count, -1 for too many arguments, +50 for fewer; per argument
    +50 equal, +25 compatible, -10 not, 0 unknown or empty."""
    n, m = F.size(arguments), F.size(parameters)
    count = F.when(n == m, 100).when(n > m, -1).otherwise(50)

    def one(a: Column, p: Column) -> Column:
        return F.when(a.isNull() | p.isNull(), 0).when(a == p, 50).when(compatible(a, p), 25).otherwise(-10)

    k = F.least(n, m)
    known = F.transform(F.slice(arguments, F.lit(1), k), lambda a: F.when(~a.isin("", "Unknown"), base_type(a)))
    asked = F.transform(F.slice(parameters, F.lit(1), k), lambda p: F.when(p != "", base_type(p)))
    scores = F.zip_with(known, asked, one)
    return (count + F.aggregate(scores, F.lit(0), lambda s, x: s + x)).cast("int")


def build_fqn(*parts: Column) -> Column:
    """Parts of a name joined by points, NULL and empty ones left out; NULL if nothing is left."""
    kept = [F.nullif(p, F.lit("")) for p in parts]
    return F.nullif(F.concat_ws(".", *kept), F.lit(""))
