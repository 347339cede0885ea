"""DuckDB SQL building blocks for the equivalence checks.

They restate the operators on unnested rows, windows and joins, so that a mistake in the
array expressions of the Spark side does not repeat itself here.
"""

from __future__ import annotations

from itertools import accumulate

from noisemix.functions.letters import LETTER_TRANSITION, LETTER_WEIGHT
from noisemix.operators.noise import append_powers
from noisemix.plans.recipes import Recipe

WS = r"[ \t\n\x0B\f\r]"
PUNCT = r"[!-/:-@\[-`{-~]"
MARK = chr(0x2581)


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda tk: tk <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{PUNCT}', '', 'g')"


def letters_only(x: str) -> str:
    return rf"regexp_matches({x}, '^\p{{L}}+$')"


def ends_sentence(x: str) -> str:
    return (
        f"({x} LIKE '%.' AND NOT regexp_matches({x}, '[A-Z]') AND NOT "
        rf"regexp_matches({x}, '(a\.m\.|p\.m\.|e\.g\.|i\.e\.|cf\.|\.\.\.)$'))"
    )


def detached(x: str) -> str:
    return (
        f"list_transform([{tokens(x)}], lambda tl: list_filter(flatten(list_transform(tl, "
        f"lambda tk, ix: CASE WHEN ix < len(tl) AND {ends_sentence('tk')} "
        "THEN [left(tk, length(tk) - 1), '.'] ELSE [tk] END)), lambda tk: tk <> ''))[1]"
    )


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def reattached(x: str) -> str:
    return tokens(f"replace({joined(x)}, ' . ', '. ')")


def digest(op: str, *key: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}|{op}', {', '.join(key)}))"


def lane(h: str, number: int | str = 0) -> str:
    start = 1 + 8 * number if isinstance(number, int) else f"(1 + 8 * ({number}))::bigint"
    return f"(('0x' || substr({h}, {start}, 8))::bigint::double / 4294967296)"


def uniform(op: str, *key: str, seed: int = 42) -> str:
    return lane(digest(op, *key, seed=seed))


def capital(x: str) -> str:
    return (
        f"(CASE WHEN substr({x}, 1, 1) = 'ß' THEN 'ß' ELSE upper(substr({x}, 1, 1)) END "
        f"|| lower(substr({x}, 2)))"
    )


def open_token(x: str, proper: str) -> str:
    return f"(CASE WHEN {x} = 'I' THEN {x} WHEN {proper} THEN {capital(x)} ELSE lower({x}) END)"


def conjunction(u: str) -> str:
    return f"([' and', ', and', ',', ',', ';'])[floor({u} * 5)::int + 1]"


def close_clause(c: str, u: str) -> str:
    last, before, body = f"right({c}, 1)", f"left(right({c}, 2), 1)", f"left({c}, length({c}) - 1)"
    conj = conjunction(u)
    return (
        f"(CASE WHEN NOT regexp_matches({last}, '{PUNCT}') THEN {c} || {conj} "
        f"WHEN {last} IN ('\"', '''') AND length({c}) > 1 AND {before} <> ' ' THEN "
        f"CASE WHEN regexp_matches({before}, '{PUNCT}') THEN left({c}, length({c}) - 2) || "
        f"([',', ',', ';'])[floor({u} * 3)::int + 1] || {last} "
        f"WHEN {conj} = ' and' THEN {c} || {conj} "
        f"WHEN {conj} = ', and' THEN {body} || ',' || {last} || ' and' "
        f"ELSE {body} || {conj} || {last} END "
        f"ELSE {body} || {conj} END)"
    )


def split(key: str) -> str:
    return f"CASE WHEN {key} % 10 < 8 THEN 'train' WHEN {key} % 10 = 8 THEN 'dev' ELSE 'test' END"


LINES = f"""lines AS (
  SELECT doc_id, pos, lang, source, line AS src, concat(doc_id, ':', pos) AS row_key,
    {split("doc_id")} AS split
  FROM (SELECT doc_id, lang, source, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))
  WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]'))"""

# Prepared lines: detached tokens and positions of proper nouns.
BASE = f"""raw_inside AS (
  SELECT {strip("t")} AS w, i, lag(t) OVER (PARTITION BY row_key ORDER BY i) AS before
  FROM (SELECT row_key, unnest(tk) AS t, unnest(range(len(tk))) AS i
        FROM (SELECT row_key, {tokens("src")} AS tk FROM lines))),
lexicon AS (
  SELECT lower(w) AS word, count(*) AS inside,
    count(*) FILTER (substr(w, 1, 1) <> lower(substr(w, 1, 1))) AS capitalised
  FROM raw_inside WHERE i > 0 AND w <> '' AND NOT regexp_matches(before, '[.?!]$')
  GROUP BY 1 HAVING count(*) FILTER (substr(w, 1, 1) <> lower(substr(w, 1, 1))) * 2 > count(*)),
detached AS (SELECT *, {detached("src")} AS tokens, {norm("src")} AS tgt FROM lines),
opening AS (
  SELECT row_key, row_number() OVER (PARTITION BY row_key ORDER BY i) - 1 AS clause, t FROM (
    SELECT row_key, i, t, lag(t) OVER (PARTITION BY row_key ORDER BY i) AS before
    FROM (SELECT row_key, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM detached))
  WHERE i = 0 OR before = '.'),
proper AS (
  SELECT row_key, list(clause ORDER BY clause) AS proper_at FROM opening
  WHERE {strip("lower(t)")} IN (SELECT word FROM lexicon) GROUP BY row_key),
base AS (
  SELECT detached.*, coalesce(proper_at, []::bigint[]) AS proper_at
  FROM detached LEFT JOIN proper USING (row_key))"""


def _map(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


_WEIGHTS = _map(
    {a: w for k, w in LETTER_WEIGHT.items() for a in (k, k.upper())}
)
_RUNNING = _map({k: list(accumulate(v.values())) for k, v in LETTER_TRANSITION.items()})
_LETTERS = _map({k: "'" + "".join(v) + "'" for k, v in LETTER_TRANSITION.items()})


def edit_word(w: str, h: str) -> str:
    """One typo on word ``w`` from the lanes of ``h``."""
    weights = (
        f"list_transform(range(1, length({w}) + 1), "
        f"lambda cp: coalesce({_WEIGHTS}[substr({w}, cp, 1)], 0))"
    )
    running = (
        f"list_transform(range(1, length({w}) + 1), lambda cq: list_sum(({weights})[1:cq]))"
    )
    hit = f"len(list_filter({running}, lambda cr: cr <= {lane(h, 2)} * list_sum({weights})))"
    # [slot, old letter] packed once through a one-element list
    typed = (
        f"list_transform([{hit}], lambda sl: left({w}, sl) || "
        "list_transform([substr({w}, sl + 1, 1)], lambda ol: "
        "list_transform([substr({letters}[lower(ol)], 1 + len(list_filter({running}[lower(ol)], "
        "lambda cs: cs <= {u} * {running}[lower(ol)][-1])), 1)], "
        "lambda nl: CASE WHEN lower(ol) <> ol THEN upper(nl) ELSE nl END)[1])[1] "
        "|| substr({w}, sl + 2))[1]"
    ).replace("{w}", w).replace("{letters}", _LETTERS).replace("{running}", _RUNNING).replace(
        "{u}", lane(h, 3)
    )
    at = f"floor({lane(h, 2)} * (length({w}) - 1))::int"
    swapped = (
        f"left({w}, {at}) || substr({w}, {at} + 2, 1) || substr({w}, {at} + 1, 1) "
        f"|| substr({w}, {at} + 3)"
    )
    return (
        f"(CASE WHEN {lane(h, 1)} < 0.5 THEN CASE WHEN regexp_matches({w}, '[A-Za-z]') "
        f"THEN {typed} ELSE {w} END "
        rf"WHEN regexp_matches({w}, '\p{{L}}.*\p{{L}}') THEN {swapped} ELSE {w} END)"
    )


def sub_made(w: str, h: str) -> str:
    return f"({lane(h, 1)} < 0.5 AND regexp_matches({w}, '[A-Za-z]'))"


def swap_made(w: str, h: str) -> str:
    return rf"({lane(h, 1)} >= 0.5 AND regexp_matches({w}, '\p{{L}}.*\p{{L}}'))"


def typo(src: str, out: str, p: float) -> str:
    """Relation ``out(row_key, tokens, sub, swap)`` from ``src(row_key, tokens, ...)``."""
    return f"""{out}_tok AS (
  SELECT row_key, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM {src}),
{out}_w AS (
  SELECT row_key, i, w, sum(w) OVER (PARTITION BY row_key ORDER BY i) AS cum
  FROM (SELECT row_key, i,
          CASE WHEN length(s) >= 6 AND {letters_only("s")} THEN length(s) ELSE 0 END AS w
        FROM (SELECT row_key, i, {strip("t")} AS s FROM {out}_tok)) WHERE w > 0),
{out}_k AS (
  SELECT row_key, total,
    least(greatest(floor(len(tokens) * {p}::double)::bigint, 1), words) AS k
  FROM (SELECT row_key, max(cum) AS total, count(*) AS words FROM {out}_w GROUP BY row_key)
  JOIN {src} USING (row_key) WHERE len(tokens) >= 4),
{out}_draw AS (
  SELECT row_key, total, d, {digest("typo", "row_key", "d")} AS h
  FROM (SELECT row_key, total, unnest(range(1, k + 1)) AS d FROM {out}_k)),
{out}_hit AS (
  SELECT d.row_key, e.i, list(h ORDER BY d) AS hs
  FROM {out}_draw d JOIN {out}_w e ON d.row_key = e.row_key
    AND {lane("h", 0)} * total >= e.cum - e.w AND {lane("h", 0)} * total < e.cum
  GROUP BY 1, 2),
{out}_word AS (
  SELECT row_key, i, coalesce(list_reduce(hs, lambda wd, hx: {edit_word("wd", "hx")}, t), t) AS t,
    coalesce(len(list_filter(hs, lambda hy: {sub_made("t", "hy")})), 0) AS sub,
    coalesce(len(list_filter(hs, lambda hz: {swap_made("t", "hz")})), 0) AS swap
  FROM {out}_tok LEFT JOIN {out}_hit USING (row_key, i)),
{out} AS (
  SELECT row_key, list(t ORDER BY i) AS tokens, sum(sub)::bigint AS sub, sum(swap)::bigint AS swap
  FROM {out}_word GROUP BY row_key)"""


def runon(src: str, out: str, p: float, proper: str = "proper_at") -> str:
    """Relation ``out(row_key, tokens, runons)`` from ``src(row_key, tokens, proper_at)``."""
    return f"""{out}_tok AS (
  SELECT row_key, t, i, proper_at, h, clause, inner_stop,
    (inner_stop AND {lane("h", 0)} < {p}::double) AS chosen
  FROM (SELECT *, {digest("runon", "row_key", "clause")} AS h FROM (
    SELECT row_key, t, i, proper_at, (t = '.' AND i < n - 1) AS inner_stop,
      count(*) FILTER (t = '.' AND i < n - 1) OVER (PARTITION BY row_key ORDER BY i) AS clause
    FROM (SELECT row_key, unnest(tokens) AS t, unnest(range(len(tokens))) AS i,
            len(tokens) AS n, {proper} AS proper_at FROM {src})))),
{out}_run AS (
  -- a chosen period swallows the next token, so of several chosen in a row every second counts
  SELECT *, (i - 1 - coalesce(max(CASE WHEN NOT chosen THEN i END) OVER (
      PARTITION BY row_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) % 2 = 1
    AS swallowed
  FROM {out}_tok),
{out} AS (
  SELECT row_key, {tokens("s")} AS tokens, runons FROM (
    SELECT row_key, count(*) FILTER (chosen AND NOT swallowed) AS runons,
      string_agg(CASE
        WHEN swallowed THEN ' ' || {open_token("t", "list_contains(proper_at, clause - inner_stop::int)")}
        WHEN chosen THEN {conjunction(lane("h", 1))}
        WHEN inner_stop THEN '.'
        ELSE ' ' || t END, '' ORDER BY i) AS s
    FROM {out}_run GROUP BY row_key))"""


def noise(src: str, out: str, recipe: Recipe) -> str:
    """Relation ``out(row_key, tokens, sub, swap, runon)``: the steps of a recipe in a line."""
    ctes, last, columns = [], src, {"sub": "0", "swap": "0", "runon": "0"}
    proper = f"{src}.proper_at"
    if recipe.p("typo") is not None:
        ctes.append(typo(src, f"{out}_ty", recipe.p("typo")))
        ctes.append(
            f"{out}_tp AS (SELECT ty.*, s.proper_at FROM {out}_ty ty JOIN {src} s USING (row_key))"
        )
        last = f"{out}_tp"
        columns.update(sub="ty.sub", swap="ty.swap")
    if recipe.p("runon_line") is not None:
        ctes.append(runon(last, f"{out}_ru", recipe.p("runon_line")))
        columns["runon"] = "ru.runons"
    body = "ru.tokens" if recipe.p("runon_line") is not None else (
        "ty.tokens" if recipe.p("typo") is not None else "s.tokens"
    )
    joins = ""
    if recipe.p("typo") is not None:
        joins += f" JOIN {out}_ty ty USING (row_key)"
    if recipe.p("runon_line") is not None:
        joins += f" JOIN {out}_ru ru USING (row_key)"
    picked = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    ctes.append(
        f"{out} AS (SELECT row_key, {reattached(body)} AS tokens, {picked} FROM {src} s{joins})"
    )
    return ",\n".join(ctes)


def combine(own: str, out: str, recipe: Recipe, size: int) -> str:
    """Multi-line run-ons: ``out(row_key, noisy_src, noisy_tgt, n_append, ...)``.

    Needs ``base`` with ``batch_id, ord`` and the relation ``own`` from :func:`noise`.
    """
    powers = append_powers(recipe.p("runon_comb"), size - 1)
    chances = "[" + ", ".join(f"{x!r}::double" for x in powers) + "]"
    blocks = "[" + ", ".join(digest("append", "row_key", str(b)) for b in range((len(powers) + 3) // 4)) + "]"
    hit = lane("dg[(ap // 4) + 1]", "ap % 4")
    free = lane(digest("partner", "ky", "dr"))
    # state: the line itself, then the partners chosen so far
    draw = (
        "list_append(st, list_reduce(list_sort(st), lambda a, tk: "
        f"CASE WHEN a >= tk THEN a + 1 ELSE a END, floor({free} * (nn - len(st)))::bigint))"
    )
    clause = "tokens" if not recipe.compound else "noised"
    partner_ctes = ""
    if recipe.compound:
        partner_ctes = (
            f"{out}_inst AS (SELECT concat(p.row_key, '>', b.row_key) AS row_key, b.tokens, "
            f"b.proper_at, p.row_key AS line_key, p.j FROM {out}_pair p JOIN {out}_n b "
            f"ON p.batch_id = b.batch_id AND p.who = b.me),\n"
            + noise(f"{out}_inst", f"{out}_pn", recipe)
            + f",\n{out}_clause AS (SELECT i.line_key AS row_key, i.j, e.tokens, i.proper_at, "
            f"e.sub, e.swap, e.runon FROM {out}_inst i JOIN {out}_pn e USING (row_key))"
        )
    else:
        partner_ctes = (
            f"{out}_clause AS (SELECT p.row_key, p.j, b.tokens, b.proper_at, 0 AS sub, 0 AS swap, "
            f"0 AS runon FROM {out}_pair p JOIN {out}_n b ON p.batch_id = b.batch_id AND p.who = b.me)"
        )
    opened = (
        f"concat_ws(' ', {open_token('tokens[1]', 'list_contains(proper_at, 0)')}, "
        "CASE WHEN len(tokens) > 1 THEN array_to_string(tokens[2:], ' ') END)"
    )
    return f"""{out}_n AS (
  SELECT row_key, batch_id, tokens, proper_at, tgt,
    row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS me,
    count(*) OVER (PARTITION BY batch_id) AS n FROM base),
{out}_m AS (
  SELECT row_key, batch_id, me, n, len(list_filter(range(least(n - 1, {len(powers)})),
    lambda ap: {hit} < ({chances})[ap + 1])) AS m
  FROM (SELECT *, {blocks} AS dg FROM {out}_n)),
{out}_p AS (
  SELECT row_key, batch_id, m, (list_reduce(
      list_transform(range(1, m + 1), lambda d0: [d0, n]::bigint[]),
      lambda st, dn: list_transform([[dn[1], dn[2]]], lambda dd: {draw.replace("ky", "row_key").replace("dr", "dd[1]").replace("nn", "dd[2]")})[1],
      [me]::bigint[]))[2:] AS chosen
  FROM {out}_m),
{out}_pair AS (
  SELECT row_key, batch_id, unnest(chosen) AS who, unnest(range(1, len(chosen) + 1)) AS j FROM {out}_p),
{partner_ctes},
{out}_all AS (
  SELECT row_key, 0 AS j, {joined("o.tokens")} AS c, o.sub, o.swap, o.runon FROM {own} o
  UNION ALL SELECT row_key, j, {opened} AS c, sub, swap, runon FROM {out}_clause),
{out}_src AS (
  SELECT a.row_key, sum(sub)::bigint AS n_sub, sum(swap)::bigint AS n_swap,
    sum(runon)::bigint AS n_runon, max(m) AS n_append,
    string_agg(CASE WHEN j < m THEN {close_clause("c", uniform("close", "a.row_key", "j"))} ELSE c END,
      ' ' ORDER BY j) AS noisy_src
  FROM {out}_all a JOIN {out}_p USING (row_key) GROUP BY a.row_key),
{out}_tgt AS (
  SELECT p.row_key, string_agg(b.tgt, ' ' ORDER BY j) AS more
  FROM {out}_pair p JOIN {out}_n b ON p.batch_id = b.batch_id AND p.who = b.me GROUP BY p.row_key),
{out} AS (
  SELECT s.*, CASE WHEN more IS NULL THEN b.tgt ELSE b.tgt || ' ' || more END AS noisy_tgt
  FROM {out}_src s JOIN base b USING (row_key) LEFT JOIN {out}_tgt USING (row_key))"""


def variants() -> str:
    """Relation ``variants`` from ``lines``."""
    from noisemix.sources.corpora import VARIANT_SQL

    kinds = " UNION ALL ".join(
        f"SELECT doc_id, pos, split, '{k}' AS kind, {sql} AS src FROM lines"
        for k, sql in VARIANT_SQL.items()
    )
    return f"""variants AS (
  SELECT *, CASE WHEN kind IN ('both', 'runon') THEN lower(src) END AS tgt FROM ({kinds})
  WHERE ('0x' || substr(md5(concat_ws('|', 'gap', doc_id, pos, kind)), 1, 1))::int >= 3)"""


def pairs() -> str:
    """Relation ``pairs`` from ``lines``."""
    from noisemix.sources.corpora import HYPOTHESIS_SQL

    cells = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{s}' AS system, '{e}' AS eval_set, {sql} AS hyp, src AS ref FROM lines"
        for (s, e), sql in HYPOTHESIS_SQL.items()
    )
    return f"pairs AS ({cells})"
