"""Resolution of calls: types by name, methods along the hierarchy, overloads, and an ordered cascade of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import function_name, reference_text
from graphloom.functions.types import base_type, build_fqn, compatible, overload_score
from graphloom.session import Scratch

TYPE_KINDS = ["class", "interface", "object", "enum", "annotation"]
# Functions that every enum has without declaring them.
ENUM_FUNCTIONS = ["valueOf", "values", "entries"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def function_symbols(symbols: DataFrame) -> DataFrame:
    """(name, fqn, declaring, package_name, param_types, is_extension, receiver_type, ins_seq) of functions, each delivery once."""
    f = symbols.where("kind = 'function' and fqn is not null and name is not null")
    return f.select("name", "fqn", reference_text(F.col("declaring_type_fqn")).alias("declaring"), "package_name", F.coalesce("param_types", _empty()).alias("param_types"), "is_extension", "receiver_type", "ins_seq").distinct()


def type_symbols(symbols: DataFrame) -> DataFrame:
    """(type, simple, kind, super_class, interfaces, package_name): the last row of every type."""
    t = symbols.where(F.col("kind").isin(TYPE_KINDS) & F.col("fqn").isNotNull())
    last = t.groupBy("fqn").agg(F.max(F.struct("ins_seq", "name", "kind", "super_class", "interfaces", "package_name")).alias("s"))
    return last.select(F.col("fqn").alias("type"), F.col("s.name").alias("simple"), "s.kind", "s.super_class", "s.interfaces", "s.package_name")


def file_packages(symbols: DataFrame) -> DataFrame:
    """(file_path, package): the package of every file that has one."""
    return symbols.where("file_path is not null and package_name is not null").groupBy("file_path").agg(F.min("package_name").alias("package"))


def resolve_types(asked: DataFrame, types: DataFrame) -> DataFrame:
    """(package, ref, type) of distinct (package, ref): a type by its fqn, else in the same package, else by a simple name that only one type has."""
    a = asked.where("ref is not null").select("package", "ref").distinct().withColumn("_local", build_fqn(F.col("package"), F.col("ref")))
    fqns = types.select("type")
    unique = types.where("simple is not null").groupBy("simple").agg(F.min("type").alias("_u"), F.count(F.lit(1)).alias("n")).where("n = 1").select("simple", "_u")
    out = (
        a.join(fqns.select(F.col("type").alias("ref"), F.col("type").alias("_f")), "ref", "left")
        .join(fqns.select(F.col("type").alias("_local"), F.col("type").alias("_p")), "_local", "left")
        .join(unique.withColumnRenamed("simple", "ref"), "ref", "left")
    )
    return out.select("package", "ref", F.coalesce("_f", "_p", "_u").alias("type")).where("type is not null")


def type_parents(types: DataFrame) -> DataFrame:
    """(type, ord, parent): superclass, then interfaces in order, as far as they resolve to types."""
    refs = F.concat(F.array("super_class"), F.coalesce("interfaces", _empty()))
    p = types.select("type", F.col("package_name").alias("package"), F.posexplode(refs).alias("ord", "text")).select("type", "package", "ord", reference_text(F.col("text")).alias("ref")).where("ref is not null")
    found = resolve_types(p, types).withColumnRenamed("type", "parent")
    on = p["package"].eqNullSafe(found["package"]) & (p["ref"] == found["ref"])
    return p.join(found, on).select(p["type"], "ord", "parent").where("type <> parent")


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(type, ancestor, path): every type above the given ones, and themselves; the order of the paths is the depth-first order of the search for a method.

    parents: type, ord, parent; starts: type. Of several ways to an ancestor the first one counts, so only ways that
    improve are followed and cycles end. Each round is written to the shared folder.
    """
    scratch = Scratch(parents.sparkSession)
    up = scratch.keep(parents.select(F.col("type").alias("ancestor"), "ord", "parent"))
    known = scratch.keep(starts.select("type", F.col("type").alias("ancestor"), F.array().cast("array<int>").alias("path")).distinct())
    new = known
    while True:
        step = new.join(up, "ancestor").select("type", F.col("parent").alias("ancestor"), F.concat("path", F.array("ord")).alias("path"))
        step = step.groupBy("type", "ancestor").agg(F.min("path").alias("path"))
        old = known.withColumnRenamed("path", "_old")
        new = scratch.keep(step.join(old, ["type", "ancestor"], "left").where("_old is null or path < _old").drop("_old"))
        if not new.limit(1).count():
            return known
        merged = scratch.keep(known.unionByName(new).groupBy("type", "ancestor").agg(F.min("path").alias("path")))
        scratch.drop(known)
        known = merged


def methods_of_types(functions: DataFrame, parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(type, name, to_fqn): what a call of `name` on a type leads to: its own method, else the first one in the hierarchy.

    Overloads in one type have one fqn, so their choice does not matter here.
    """
    own = functions.where("declaring is not null").groupBy("declaring", "name").agg(F.min_by("fqn", "ins_seq").alias("fqn"))
    far = ancestors(parents, starts).join(own.withColumnRenamed("declaring", "ancestor"), "ancestor")
    return far.groupBy("type", "name").agg(F.min_by("fqn", "path").alias("to_fqn"))


def choose_overload(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and p (struct fqn, score): the best candidate of every key. scored: keys, fqn, ins_seq, score, fits.

    The greatest score wins if it is above 0; else a candidate that alone has the right number of
    parameters; else the first one indexed. Equal scores: the first one indexed.
    """
    chosen = scored.groupBy(*keys).agg(
        F.max_by(F.struct("fqn", "score"), F.struct("score", -F.col("ins_seq"))).alias("top"),
        F.count_if("fits").alias("n_fit"), F.min_by(F.struct("fqn", "score"), F.when(F.col("fits"), F.col("ins_seq"))).alias("fit"),
        F.min_by(F.struct("fqn", "score"), "ins_seq").alias("first"),
    )
    pick = F.when(F.col("top.score") > 0, F.col("top")).when(F.col("n_fit") == 1, F.col("fit")).otherwise(F.col("first"))
    return chosen.select(*keys, pick.alias("p"))


def _scored(kinds: DataFrame, functions: DataFrame) -> DataFrame:
    """Candidates of the called name with their scores."""
    score = overload_score(F.col("args"), F.col("param_types"))
    return kinds.join(functions, "name").withColumn("score", score).withColumn("fits", F.size("param_types") == F.size("args"))


def best_overloads(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, to_fqn, score): the best candidate of the called name for every call that has any (`choose_overload`).

    Calls with equal name and argument types are scored once, so a function with a tenth of all calls
    costs as many comparisons as it has kinds of calls.
    """
    asked = calls.select("call_id", function_name(F.col("callee_function_name")).alias("name"), F.coalesce("arg_types", _empty()).alias("args")).where("name is not null").distinct()
    chosen = choose_overload(_scored(asked.select("name", "args").distinct(), function_symbols(symbols)), ["name", "args"])
    return asked.join(chosen, ["name", "args"]).select("call_id", F.col("p.fqn").alias("to_fqn"), F.col("p.score").alias("score"))


def extension_functions(kinds: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, rtype, args, to_fqn): the extension function for a receiver of type rtype: of that type, else of one it is compatible with, else any."""
    keys = ["name", "rtype", "args"]
    ext = functions.where("is_extension").withColumn("_on", F.substring_index(reference_text(F.col("receiver_type")), ".", -1))
    asked = kinds.select(*keys).distinct().withColumn("_base", base_type(F.col("rtype")))
    tier = F.when(F.col("_on") == F.substring_index("_base", ".", -1), 0).when(compatible(F.col("_base"), F.col("_on")), 1).otherwise(2)
    chosen = choose_overload(_scored(asked, ext).withColumn("tier", tier), [*keys, "tier"])
    return chosen.groupBy(*keys).agg(F.min_by("p", "tier").alias("p")).select(*keys, F.col("p.fqn").alias("to_fqn"))


def _lookup(c: DataFrame, found: DataFrame, keys: dict[str, str], value: str, name: str) -> DataFrame:
    """c with a column `name`: found's value for equal keys (column of c -> column of found); at most one row of found has a key."""
    t = found.select(*[F.col(v).alias(f"_k{i}") for i, v in enumerate(keys.values())], F.col(value).alias(name))
    on = None
    for i, k in enumerate(keys):
        e = c[k].eqNullSafe(t[f"_k{i}"]) if k in ("package", "rtype") else c[k] == t[f"_k{i}"]
        on = e if on is None else on & e
    return c.join(t, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


#: The strategies of `resolve_calls` in their order.
STEPS = ("0 qualified", "0.5 constructor", "1 receiver type", "2 property", "2 companion", "2 object", "2 enum", "3 own class", "5 package", "7 extension", "8 any", "10 library")


def resolve_calls(calls: DataFrame, symbols: DataFrame, properties: DataFrame | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """(call_id, step, to_fqn): where a call leads, by the first strategy that finds something (STEPS).

    calls: call_id, callee_function_name, callee_class_name (type of the receiver), receiver, caller_class_name, arg_types,
    file_path; symbols; properties: declaring_type_fqn, name, prop_type; libraries: fqn of library types.

    0 the receiver is a full name; 0.5 no receiver and a type's name: its constructor; 1 method of the receiver's type or of
    what it inherits from; 2 the receiver is a property of the own class, with a method of its type, or a class, object or
    enum, with a method of its companion, its own, or one that every enum has; 3 method of the own class or of what it inherits
    from; 5 function of the file's package; 7 with a receiver, an extension function; 8 any function of that name; 10 a library type.
    Strategies 7 and 8 choose among overloads. Types are found by full name, in the file's package, or by a
    name that only one type has. Steps 4, 6 and 9 need imports and a catalogue of functions, which the tables lack.
    Calls that nothing resolves and calls without a name have no row; repeated rows of a call count once.
    """
    scratch = Scratch(calls.sparkSession)
    f, t = scratch.keep(function_symbols(symbols)), scratch.keep(type_symbols(symbols))
    clean = lambda c: F.nullif(function_name(F.col(c)), F.lit(""))
    c = calls.select(
        "call_id", clean("callee_function_name").alias("name"), reference_text(F.col("callee_class_name")).alias("rtype"), clean("receiver").alias("receiver"),
        clean("caller_class_name").alias("own"), F.coalesce("arg_types", _empty()).alias("args"), "file_path",
    ).where("name is not null").distinct()
    c = c.join(file_packages(symbols), "file_path", "left").withColumn("own_fqn", F.when(F.col("own").isNotNull(), build_fqn(F.col("package"), F.col("own")))).drop("file_path")
    if properties is not None:
        props = properties.where("prop_type is not null").groupBy(reference_text(F.col("declaring_type_fqn")).alias("owner"), "name").agg(F.min("prop_type").alias("ptype"))
        c = _lookup(c, props.where("owner is not null"), {"own_fqn": "owner", "receiver": "name"}, "ptype", "ptype").withColumn("ptype", reference_text(F.col("ptype")))
    else:
        c = c.withColumn("ptype", F.lit(None).cast("string"))
    c = scratch.keep(c)
    asked = c.select("package", F.explode(F.array("rtype", "ptype", "receiver", "name")).alias("ref"))
    named = scratch.keep(resolve_types(asked, t))
    for ref in ("rtype", "ptype", "receiver", "name"):
        c = _lookup(c, named, {"package": "package", ref: "ref"}, "type", f"{ref}_type")
    kinds = t.select("type", "kind")
    c = scratch.keep(_lookup(_lookup(c, kinds, {"receiver_type": "type"}, "kind", "receiver_kind"), kinds, {"name_type": "type"}, "kind", "name_kind"))
    starts = c.select(F.explode(F.array("rtype_type", "ptype_type", "own_fqn")).alias("type")).where("type is not null").distinct()
    methods = scratch.keep(methods_of_types(f, type_parents(t), starts))
    of_type = f.where("declaring is not null").groupBy("declaring", "name").agg(F.min_by("fqn", "ins_seq").alias("fqn"))
    every = f.select("fqn").distinct()
    is_object = F.col("receiver_kind").isin("class", "object", "enum")
    c = c.withColumns({
        "q1": F.when(F.contains("receiver", F.lit(".")), F.concat_ws(".", "receiver", "name")), "q2": F.when(F.contains("receiver", F.lit(".")), F.concat_ws(".", "receiver", F.lit("Companion"), "name")),
        "holder": F.when(is_object, F.col("receiver_type")), "companion": F.when(is_object, F.concat("receiver_type", F.lit(".Companion"))),
    })
    c = _lookup(_lookup(c, every, {"q1": "fqn"}, "fqn", "f1"), every, {"q2": "fqn"}, "fqn", "f2")
    for key, at in (("rtype_type", "s1"), ("ptype_type", "s2"), ("own_fqn", "s3")):
        c = _lookup(c, methods, {key: "type", "name": "name"}, "to_fqn", at)
    for key in ("companion", "holder"):
        c = _lookup(c, of_type, {key: "declaring", "name": "name"}, "fqn", f"s_{key}")
    top = f.where("declaring is null and package_name is not null").groupBy("package_name", "name").agg(F.min_by("fqn", "ins_seq").alias("fqn"))
    c = _lookup(c, top, {"package": "package_name", "name": "name"}, "fqn", "s5")
    c = scratch.keep(c)
    extensions = extension_functions(c.where("receiver is not null"), f)
    c = _lookup(c, extensions, {"name": "name", "rtype": "rtype", "args": "args"}, "to_fqn", "s7")
    anywhere = choose_overload(_scored(c.select("name", "args").distinct(), f), ["name", "args"]).select("name", "args", F.col("p.fqn").alias("fqn"))
    c = _lookup(c, anywhere, {"name": "name", "args": "args"}, "fqn", "s8")
    if libraries is not None:
        lib = libraries.where("fqn is not null").groupBy(F.substring_index("fqn", ".", -1).alias("simple")).agg(F.min("fqn").alias("fqn"))
        c = _lookup(c.withColumn("_simple", F.substring_index("rtype", ".", -1)), lib, {"_simple": "simple"}, "fqn", "_lib")
    else:
        c = c.withColumn("_lib", F.lit(None).cast("string"))
    made = F.col("receiver").isNull() & F.col("name").rlike(r"^\p{Lu}") & F.col("name_kind").isin("class", "enum", "annotation")
    found = [
        F.coalesce("f1", "f2"), F.when(made, F.concat("name_type", F.lit(".<init>"))), F.col("s1"), F.col("s2"), F.col("s_companion"), F.col("s_holder"),
        F.when((F.col("receiver_kind") == "enum") & F.col("name").isin(ENUM_FUNCTIONS), F.concat_ws(".", "receiver_type", "name")), F.col("s3"), F.col("s5"),
        F.when(F.col("receiver").isNotNull(), F.col("s7")), F.col("s8"), F.when(F.col("_lib").isNotNull(), F.concat_ws(".", "_lib", "name")),
    ]
    best = F.coalesce(*[F.when(x.isNotNull(), F.struct(F.lit(step).alias("step"), x.alias("to_fqn"))) for step, x in zip(STEPS, found, strict=True)])
    return c.select("call_id", best.alias("b")).where("b is not null").select("call_id", "b.step", "b.to_fqn")


def resolve_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, from_fqn): the function a call stands in: package, class and function of its file; else the function of that name in the file; else the only one of that name."""
    f = function_symbols(symbols)
    clean = lambda c: F.nullif(function_name(F.col(c)), F.lit(""))
    c = calls.select("call_id", clean("caller_function_name").alias("name"), clean("caller_class_name").alias("own"), "file_path").where("name is not null").distinct()
    c = c.join(file_packages(symbols), "file_path", "left").withColumn("full", build_fqn(F.col("package"), F.col("own"), F.col("name")))
    c = _lookup(c, f.select("fqn").distinct(), {"full": "fqn"}, "fqn", "by_name")
    in_file = symbols.where("kind = 'function' and fqn is not null").groupBy("file_path", "name").agg(F.min_by("fqn", "ins_seq").alias("fqn"))
    c = _lookup(c, in_file, {"file_path": "file_path", "name": "name"}, "fqn", "in_file")
    only = f.groupBy("name").agg(F.min("fqn").alias("fqn"), F.max("fqn").alias("last")).where("fqn = last")
    c = _lookup(c, only, {"name": "name"}, "fqn", "only")
    return c.select("call_id", F.coalesce("by_name", "in_file", "only").alias("from_fqn")).where("from_fqn is not null")
