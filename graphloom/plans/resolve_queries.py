"""Queries of call resolution over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import function_name
from graphloom.functions.types import ASSIGNABLE_TO, STANDS_FOR, WIDENS_TO
from graphloom.operators import resolve
from graphloom.session import table

_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_NM = lambda c: rf"nullif(regexp_replace(regexp_replace(trim({c}, {_BLANKS}), '^`(.*)`$', '\1'), '\(\)$', ''), '')"
_REF = lambda c: rf"nullif(trim(regexp_replace(trim(split_part({c}, '<', 1), {_BLANKS}), '\?$', ''), {_BLANKS}), '')"
_BASE = lambda c: rf"regexp_replace(trim(split_part({c}, '<', 1)), '\?$', '')"
_KINDS = "('class','interface','object','enum','annotation')"


def _pairs(table_: dict[str, list[str]], a: str, p: str) -> str:
    return " OR ".join(f"({a} = '{k}' AND {p} IN ({', '.join(repr(x) for x in v)}))" for k, v in table_.items())


def compatible_sql(a: str, p: str) -> str:
    """Whether a value of type a may be passed for p; both without type arguments."""
    small = f"(left({a}, 1) = lower(left({a}, 1)) OR left({p}, 1) = lower(left({p}, 1)))"
    rule = f"CASE WHEN {small} THEN {_pairs(ASSIGNABLE_TO, a, p)} ELSE {_pairs(WIDENS_TO, a, p)} OR {_pairs(STANDS_FOR, a, p)} END"
    return f"coalesce({a} = {p} OR {a} IN ('any', 'never', 'Nothing') OR {p} IN ('any', 'unknown', 'Any') OR {rule}, false)"


def score_sql(args: str, params: str) -> str:
    a, p = f"{args}[i]", f"{params}[i]"
    one = f"CASE WHEN {a} IS NULL OR {p} IS NULL OR {a} IN ('', 'Unknown') OR {p} = '' THEN 0 WHEN {_BASE(a)} = {_BASE(p)} THEN 50 WHEN {compatible_sql(_BASE(a), _BASE(p))} THEN 25 ELSE -10 END"
    count = f"CASE WHEN len({args}) = len({params}) THEN 100 WHEN len({args}) > len({params}) THEN -1 ELSE 50 END"
    return f"({count} + coalesce(list_sum([{one} FOR i IN range(1, least(len({args}), len({params})) + 1)]), 0))::INTEGER"


_PICK = "CASE WHEN max(score) > 0 THEN first({0} ORDER BY score DESC, ins_seq) WHEN count_if(fits) = 1 THEN first({0} ORDER BY fits DESC, ins_seq) ELSE first({0} ORDER BY ins_seq) END"
_F = f"f AS (SELECT DISTINCT name, fqn, {_REF('declaring_type_fqn')} AS declaring, package_name, coalesce(param_types, []) AS param_types, is_extension, receiver_type, ins_seq FROM symbols WHERE kind = 'function' AND fqn IS NOT NULL AND name IS NOT NULL)"
_CANDIDATES = f"k.*, f.fqn, f.ins_seq, f.receiver_type, {score_sql('k.args', 'f.param_types')} AS score, len(f.param_types) = len(k.args) AS fits"
_OVERLOADS = f"""{_F}, a AS (SELECT DISTINCT call_id, {_NM('callee_function_name')} AS name, coalesce(arg_types, []) AS args FROM calls),
 s AS (SELECT {_CANDIDATES} FROM (SELECT DISTINCT name, args FROM a) k JOIN f ON f.name = k.name),
 b AS (SELECT name, args, {_PICK.format('fqn')} AS to_fqn, {_PICK.format('score')} AS score FROM s GROUP BY name, args)"""

# Written from the description of the strategies: every one is a left join of its own, the first that is not NULL counts.
CASCADE = rf"""{_F}, t AS (SELECT fqn AS type, arg_max({{'n': name, 'k': kind, 's': super_class, 'i': interfaces, 'p': package_name}}, ins_seq) AS v FROM symbols WHERE kind IN {_KINDS} AND fqn IS NOT NULL GROUP BY fqn),
 uq AS (SELECT v.n AS simple, min(type) AS type FROM t WHERE v.n IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
 pk AS (SELECT file_path, min(package_name) AS package FROM symbols WHERE package_name IS NOT NULL GROUP BY 1),
 c0 AS (SELECT DISTINCT call_id, {_NM('callee_function_name')} AS name, {_REF('callee_class_name')} AS rtype, {_NM('receiver')} AS receiver, {_NM('caller_class_name')} AS own, coalesce(arg_types, []) AS args, package
  FROM calls LEFT JOIN pk USING (file_path)),
 pr AS (SELECT {_REF('declaring_type_fqn')} AS owner, name, min(prop_type) AS ptype FROM parsed_properties WHERE prop_type IS NOT NULL GROUP BY 1, 2),
 c1 AS (SELECT c.*, CASE WHEN own IS NOT NULL THEN concat_ws('.', package, own) END AS own_fqn, {_REF('pr.ptype')} AS ptype FROM c0 c
  LEFT JOIN pr ON pr.owner = (CASE WHEN own IS NOT NULL THEN concat_ws('.', package, own) END) AND pr.name = c.receiver WHERE c.name IS NOT NULL),
 ch AS (SELECT type, v.p AS package, [v.s] || coalesce(v.i, []) AS up FROM t),
 cu AS (SELECT type, package, i AS ord, {_REF('up[i]')} AS ref FROM (SELECT *, unnest(range(1, len(up) + 1)) AS i FROM ch)),
 asked AS (SELECT DISTINCT package, ref FROM (SELECT package, unnest([rtype, ptype, receiver, name]) AS ref FROM c1 UNION ALL SELECT package, ref FROM cu) WHERE ref IS NOT NULL),
 rt AS (SELECT a.package, a.ref, coalesce(x.type, y.type, u.type) AS type FROM asked a LEFT JOIN t x ON x.type = a.ref LEFT JOIN t y ON y.type = concat_ws('.', a.package, a.ref) LEFT JOIN uq u ON u.simple = a.ref),
 tp AS (SELECT cu.type, ord, rt.type AS parent FROM cu JOIN rt ON rt.package IS NOT DISTINCT FROM cu.package AND rt.ref = cu.ref WHERE rt.type <> cu.type),
 c2 AS (SELECT c.*, r1.type AS t1, r2.type AS t2, r3.type AS t3, r4.type AS t4, k3.v.k AS k3, k4.v.k AS k4 FROM c1 c
  LEFT JOIN rt r1 ON r1.package IS NOT DISTINCT FROM c.package AND r1.ref = c.rtype LEFT JOIN rt r2 ON r2.package IS NOT DISTINCT FROM c.package AND r2.ref = c.ptype
  LEFT JOIN rt r3 ON r3.package IS NOT DISTINCT FROM c.package AND r3.ref = c.receiver LEFT JOIN rt r4 ON r4.package IS NOT DISTINCT FROM c.package AND r4.ref = c.name
  LEFT JOIN t k3 ON k3.type = r3.type LEFT JOIN t k4 ON k4.type = r4.type),
 anc AS (SELECT type, type AS ancestor, []::BIGINT[] AS path, [type] AS seen FROM (SELECT DISTINCT unnest([t1, t2, own_fqn]) AS type FROM c2) WHERE type IS NOT NULL
  UNION ALL SELECT a.type, p.parent, a.path || [p.ord], a.seen || [p.parent] FROM anc a JOIN tp p ON p.type = a.ancestor WHERE NOT list_contains(a.seen, p.parent)),
 mo AS (SELECT declaring, name, arg_min(fqn, ins_seq) AS fqn FROM f WHERE declaring IS NOT NULL GROUP BY 1, 2),
 m AS (SELECT anc.type, mo.name, first(mo.fqn ORDER BY path) AS fqn FROM anc JOIN mo ON mo.declaring = anc.ancestor GROUP BY 1, 2),
 top AS (SELECT package_name, name, arg_min(fqn, ins_seq) AS fqn FROM f WHERE declaring IS NULL AND package_name IS NOT NULL GROUP BY 1, 2),
 e0 AS (SELECT {_CANDIDATES}, CASE WHEN split_part(reverse({_REF('f.receiver_type')}), '.', 1) = split_part(reverse({_BASE('k.rtype')}), '.', 1) THEN 0
   WHEN {compatible_sql(_BASE('k.rtype'), f"reverse(split_part(reverse({_REF('f.receiver_type')}), '.', 1))")} THEN 1 ELSE 2 END AS tier
  FROM (SELECT DISTINCT name, rtype, args FROM c2 WHERE receiver IS NOT NULL) k JOIN f ON f.name = k.name AND f.is_extension),
 e1 AS (SELECT name, rtype, args, tier, {_PICK.format('fqn')} AS fqn FROM e0 GROUP BY 1, 2, 3, 4),
 e AS (SELECT name, rtype, args, arg_min(fqn, tier) AS fqn FROM e1 GROUP BY 1, 2, 3),
 o AS (SELECT name, args, {_PICK.format('fqn')} AS fqn FROM (SELECT {_CANDIDATES} FROM (SELECT DISTINCT name, args FROM c2) k JOIN f ON f.name = k.name) GROUP BY 1, 2),
 lib AS (SELECT reverse(split_part(reverse(fqn), '.', 1)) AS simple, min(fqn) AS fqn FROM external_types WHERE fqn IS NOT NULL GROUP BY 1),
 all_f AS (SELECT DISTINCT fqn FROM f),
 g AS (SELECT c.call_id, [struct_pack(step := '0 qualified', fqn := coalesce(q1.fqn, q2.fqn)),
   struct_pack(step := '0.5 constructor', fqn := CASE WHEN c.receiver IS NULL AND regexp_matches(c.name, '^\p{{Lu}}') AND k4 IN ('class', 'enum', 'annotation') THEN t4 || '.<init>' END),
   struct_pack(step := '1 receiver type', fqn := m1.fqn), struct_pack(step := '2 property', fqn := m2.fqn), struct_pack(step := '2 companion', fqn := o1.fqn), struct_pack(step := '2 object', fqn := o2.fqn),
   struct_pack(step := '2 enum', fqn := CASE WHEN k3 = 'enum' AND c.name IN ('valueOf', 'values', 'entries') THEN t3 || '.' || c.name END),
   struct_pack(step := '3 own class', fqn := m3.fqn), struct_pack(step := '5 package', fqn := top.fqn), struct_pack(step := '7 extension', fqn := e.fqn), struct_pack(step := '8 any', fqn := o.fqn),
   struct_pack(step := '10 library', fqn := lib.fqn || '.' || c.name)] AS steps
  FROM c2 c LEFT JOIN all_f q1 ON contains(c.receiver, '.') AND q1.fqn = c.receiver || '.' || c.name LEFT JOIN all_f q2 ON contains(c.receiver, '.') AND q2.fqn = c.receiver || '.Companion.' || c.name
  LEFT JOIN m m1 ON m1.type = t1 AND m1.name = c.name LEFT JOIN m m2 ON m2.type = t2 AND m2.name = c.name LEFT JOIN m m3 ON m3.type = own_fqn AND m3.name = c.name
  LEFT JOIN mo o1 ON k3 IN ('class', 'object', 'enum') AND o1.declaring = t3 || '.Companion' AND o1.name = c.name LEFT JOIN mo o2 ON k3 IN ('class', 'object', 'enum') AND o2.declaring = t3 AND o2.name = c.name
  LEFT JOIN top ON top.package_name = c.package AND top.name = c.name LEFT JOIN e ON c.receiver IS NOT NULL AND e.name = c.name AND e.rtype IS NOT DISTINCT FROM c.rtype AND e.args = c.args
  LEFT JOIN o ON o.name = c.name AND o.args = c.args LEFT JOIN lib ON lib.simple = reverse(split_part(reverse(c.rtype), '.', 1))),
 resolved AS (SELECT call_id, x.step AS step, x.fqn AS to_fqn FROM (SELECT call_id, [s FOR s IN steps IF s.fqn IS NOT NULL][1] AS x FROM g) WHERE x IS NOT NULL)"""

CALLERS = f"""cn AS (SELECT DISTINCT call_id, {_NM('caller_function_name')} AS name, {_NM('caller_class_name')} AS own, calls.file_path, package FROM calls LEFT JOIN pk USING (file_path)),
 inf AS (SELECT file_path, name, arg_min(fqn, ins_seq) AS fqn FROM symbols WHERE kind = 'function' AND fqn IS NOT NULL GROUP BY 1, 2),
 ony AS (SELECT name, min(fqn) AS fqn FROM f GROUP BY 1 HAVING min(fqn) = max(fqn)),
 callers AS (SELECT call_id, coalesce(a.fqn, i.fqn, y.fqn) AS from_fqn FROM cn LEFT JOIN all_f a ON a.fqn = concat_ws('.', package, own, cn.name) LEFT JOIN inf i ON i.file_path = cn.file_path AND i.name = cn.name
  LEFT JOIN ony y ON y.name = cn.name WHERE cn.name IS NOT NULL AND coalesce(a.fqn, i.fqn, y.fqn) IS NOT NULL)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_calls(*(table(spark, d, n) for n in ("calls", "symbols", "parsed_properties", "external_types")))


def overload_best(spark: SparkSession, d: str) -> DataFrame:
    """The best overload for every call whose name is indexed."""
    return resolve.best_overloads(table(spark, d, "calls"), table(spark, d, "symbols"))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Where every call leads, by the first strategy that finds something."""
    return _resolved(spark, d)


def resolve_callers(spark: SparkSession, d: str) -> DataFrame:
    """The function every call stands in."""
    return resolve.resolve_callers(table(spark, d, "calls"), table(spark, d, "symbols"))


def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls, resolved calls and their rate by project."""
    calls = table(spark, d, "calls")
    done = _resolved(spark, d).select("call_id", F.lit(1).alias("done"))
    named = calls.where(F.nullif(function_name(F.col("callee_function_name")), F.lit("")).isNotNull()).select("call_id", "project_path").distinct()
    per = named.join(done, "call_id", "left").groupBy("project_path").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("resolved"))
    return per.withColumn("rate", F.col("resolved") / F.col("total"))


QUERIES = {q.__name__: q for q in (overload_best, resolve_cascade, resolve_callers, resolution_stats)}
ORACLE_SQL = {
    "overload_best": f"WITH {_OVERLOADS} SELECT a.call_id, b.to_fqn, b.score FROM a JOIN b ON a.name = b.name AND a.args = b.args",
    "resolve_cascade": f"WITH RECURSIVE {CASCADE} SELECT * FROM resolved",
    "resolve_callers": f"WITH RECURSIVE {CASCADE}, {CALLERS} SELECT * FROM callers",
    "resolution_stats": f"WITH RECURSIVE {CASCADE} SELECT project_path, count(*) AS total, count(step) AS resolved, count(step) / count(*) AS rate FROM (SELECT DISTINCT call_id, project_path FROM calls WHERE {_NM('callee_function_name')} IS NOT NULL) LEFT JOIN resolved USING (call_id) GROUP BY 1",
}
