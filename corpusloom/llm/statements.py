"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations


def clusters_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The rounds of op11 written out: every round assigns all vectors and takes the floored means."""
    parts = [
        f"""vectors as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v,
    sha256('2:' || vec_id::varchar) as h
  from embeddings
  where len(embedding) = {width}
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {width})""",
        f"""c0 as materialized (
  select row_number() over (order by h nulls last, v) - 1 as cluster, v as c from vectors
  qualify row_number() over (order by h nulls last, v) <= {k})""",
    ]
    squared = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} as materialized (
  select vec_id, v, cluster, d from (select vectors.vec_id, v, cluster, {squared}::bigint as d, vectors.rowid_ as rowid_
    from (select *, row_number() over () as rowid_ from vectors) as vectors cross join c{r})
  qualify row_number() over (partition by rowid_ order by d, cluster) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} as materialized (
  select cluster, list(m order by i) as c from (
    select cluster, i, floor(sum(x) / count(*)) as m from (
      select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by cluster, i)
  group by cluster),
c{r + 1} as materialized (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))"""
            )
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, a.cluster::integer as cluster, d as distance, (sum(d) over (partition by a.cluster))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from a{rounds} as a join c{rounds} as c on a.cluster = c.cluster"""
    )


def _digest(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar)::varchar || ':' || {f}::varchar, '-')" for f in fields) + ")"


def _levels(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs {name}0 .. of nodes (grp, pos, n, digest, l, r): l and r are the joined siblings of the run."""
    run = f"over (partition by grp, pos // 16 order by pos rows between"
    parts = []
    for j in range(levels):
        nodes = leaves if j == 0 else (
            f"select grp, pos // 16 as pos, (max(n) + 15) // 16 as n, sha256(string_agg(digest, '' order by pos)) as digest "
            f"from {name}{j - 1} where n > 1 group by grp, pos // 16"
        )
        parts.append(
            f"""{name}{j} as materialized (select *,
  coalesce(string_agg(digest, '') {run} unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(digest, '') {run} 1 following and unbounded following), '') as r from ({nodes}))"""
        )
    return parts


def merkle_sql(levels: int = 6) -> str:
    """Trees of op13 of up to `levels` levels each, level by level; the CRC is folded over the digits of doc_id."""
    table = """list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, bit:
    if((c & 1) = 1, xor(c >> 1, 3988292384::bigint), c >> 1)))"""
    crc = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint),
    lambda c, byte: xor(c >> 8, crc_table[(xor(c, byte) & 255) + 1])), 4294967295::bigint)"""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = [
        f"crc as materialized (select {table} as crc_table)",
        f"""marked as materialized (
  select doc_id, source, lang, n_chars, text,
    if(coalesce({crc} % 5 = 0, false), translate(text, '{upper}', '{lower}'), text) as changed_text from documents, crc)""",
        f"""leaves as materialized (
  select *, row_number() over (partition by grp order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by grp) as n
  from (select if(source is null, '0', '1' || source) as grp, doc_id, {_digest('text')} as digest, {_digest('changed_text')} as changed
    from marked))""",
        *_levels("s", "select grp, pos, n, digest, doc_id, changed from leaves", levels),
    ]
    subroots = " union all ".join(f"select grp as src, digest from s{j} where n = 1" for j in range(levels))
    parts.append(
        f"""subroots as materialized (
  select src, digest, row_number() over (order by src) - 1 as pos, count(*) over () as n from ({subroots}))"""
    )
    parts += _levels("t", "select '' as grp, pos, n, digest, src from subroots", levels)
    root = " union all ".join(f"select digest from t{j} where n = 1" for j in range(levels))
    # Level by level: the joined siblings, and the digest of the changed row folded with them.
    parts.append("w0 as (select doc_id, grp, pos, digest as leaf, if(n > 1, l || r, '') as path, if(n > 1, sha256(l || changed || r), changed) as fold from s0)")
    step = "path || coalesce({0}.l || {0}.r, '') as path, if({0}.l is null, fold, sha256({0}.l || fold || {0}.r)) as fold"
    last = "w0"
    for j in range(1, levels):
        parts.append(
            f"w{j} as (select {last}.doc_id, {last}.grp, {last}.pos, leaf, {step.format(f's{j}')} from {last} "
            f"left join s{j} on s{j}.grp = {last}.grp and s{j}.pos = {last}.pos // {16**j} and s{j}.n > 1)"
        )
        last = f"w{j}"
    parts.append(f"x as (select doc_id, leaf, path, fold, subroots.pos as place, subroots.digest as subroot from {last} join subroots on src = grp)")
    last = "x"
    for j in range(levels):
        parts.append(
            f"x{j} as (select doc_id, leaf, subroot, place, {step.format(f't{j}')} from {last} "
            f"left join t{j} on t{j}.pos = place // {16**j} and t{j}.n > 1)"
        )
        last = f"x{j}"
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select doc_id, leaf, subroot, root, sha256(path) as proof_sha256, fold as folded_root, fold = root as verified
from {last}, (select digest as root from ({root}))"""
    )
