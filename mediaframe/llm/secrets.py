"""Operator 8: secret scans, with DataFrame and SQL functions only.

Patterns find the base kinds; two character Markov models, one of random strings and one of ordinary identifiers,
find further ones: long strings whose log-likelihood ratio speaks for the random model. The models are counted in
Python from labelled samples while the plan is made, and enter it as a table of whole numbers.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the patterns of the base kinds, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Characters of the strings that the models judge; all others separate them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE_MIN = 20
#: A candidate is a secret from this log-likelihood ratio on, in thousandths of a nat per transition.
THRESHOLD = 500

#: Words that ordinary identifiers are made of, for the labelled samples.
WORDS = (
    "account action address after amount array audio before block border bottom buffer button cache call change channel check class client close cloud code color column command "
    "config connection content context control count create current data date default delete description detail device dialog directory display document download element email enable "
    "error event export field file filter first format frame function global graph group handler header height hidden history image import index information input install integer "
    "interface internal invoice item label language last layout length level library limit link list local location login manager margin master maximum member memory menu message "
    "method minimum model module monitor mouse name network next node notification number object offset option order output package page parameter parent password path pattern "
    "payment permission picture pixel player pointer policy position previous print priority process product profile program project property protocol provider public query random "
    "range record reference region register release remote report request resource response result return row sample schedule screen script search section select sequence server "
    "service session setting shadow signal source stack start state station status storage stream string style submit summary support surface switch system table target task template "
    "terminal test text thread time title token total transaction transfer type update upload user value vector version video view visible warning width window wrapper zone "
    "abend arbeit beziehung deutschland einheit entscheidung erfahrung freundschaft gesellschaft gesundheit keiten lichkeit möglichkeit rechtsschutz schaft sprache ung verein versicherung "
    "wirtschaft zusammen ergebnis zwischen berechtigung verpflichtung auch eine nicht werden "
    "administration ailleurs aujourd beaucoup bureau chaque développement eau elle enseignement entreprise gouvernement heureux mentaires mouvement nouveau peut question toujours utilisation "
    "ayuntamiento ciones desarrollo empresa entonces español gobierno información mente nosotros organización porque trabajo universidad llamada que"
).split()


def labelled_samples(count: int = 4000, seed: int = 8) -> list[tuple[str, bool]]:
    """count random strings (True) and count ordinary identifiers (False): labelled by how they are made."""
    r = random.Random(seed)
    words = [re.sub("[^a-z]", "", w.translate(str.maketrans("äöüßéèêçñíóúá", "aouseeecniooa"))) for w in WORDS]
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62]]

    def ordinary() -> str:
        own = [r.choice(words) for _ in range(r.randint(3, 6))]
        kind = r.randrange(9)
        if kind < 3:
            return "".join(own) if kind else "".join(own).capitalize()
        if kind == 3:
            return own[0] + "".join(w.capitalize() for w in own[1:])
        if kind == 4:
            return "_".join(own) + r.choice(["", "_2", "_v2", "_id", "_2024"])
        if kind == 5:
            return "-".join(own) + r.choice(["", "-1", f"-20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}"])
        if kind == 6:
            return "/".join(own)
        if kind == 7:
            return "_".join(own).upper()
        if r.random() < 0.3:  # numbers with separators
            return "-".join(str(r.randint(10, 9999)) for _ in range(6))
        return "".join(own)

    return [("".join(r.choices(r.choice(sets), k=r.randint(20, 64))), True) for _ in range(count)] + [(ordinary(), False) for _ in range(count)] + [(c * 600, False) for c in ALPHABET]  # the last: rules, padding, drawn-out letters


def train(samples: list[tuple[str, bool]]) -> list[int]:
    """Table of log-likelihood ratios in thousandths of a nat, by (character before, character): two bigram models, smoothed."""
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [0.25] * size * size, False: [0.05] * size * size}
    for text, label in samples:
        for a, b in zip(text, text[1:]):
            if a in at and b in at:
                counts[label][at[a] * size + at[b]] += 1
    out = []
    for a in range(size):
        rows = {k: c[a * size : (a + 1) * size] for k, c in counts.items()}
        # a uniform share keeps pairs that no sample has from deciding alone
        logs = {k: [math.log(0.97 * x / sum(row) + 0.03 / size) for x in row] for k, row in rows.items()}
        out += [round(1000 * (t - f)) for t, f in zip(logs[True], logs[False])]
    return out


def score(table: list[int], text: str) -> float:
    """Mean log-likelihood ratio per transition, as the plan computes it."""
    at = {c: i for i, c in enumerate(ALPHABET)}
    return sum(table[at[a] * len(ALPHABET) + at[b]] for a, b in zip(text, text[1:])) / max(1, len(text) - 1)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _random(table: list[int]) -> str:
    """SQL over a string x: whether the models call it random."""
    size = len(ALPHABET)
    codes = [ALPHABET.find(chr(c)) for c in range(128)]
    return f"""transform(array(transform(sequence(1, length(x)), k -> get(array({", ".join(map(str, codes))}), ascii(substring(x, k, 1))))), c ->
      aggregate(sequence(1, size(c) - 1), 0L, (s, k) -> s + get(array({", ".join(map(str, table))}), c[k - 1] * {size} + c[k])) >= {THRESHOLD}L * (size(c) - 1))[0]"""


def _kinds(table: list[int]) -> list[tuple[str, str, str, str]]:
    """kind, pattern, SQL of the value in a match (z.m[k] is the match, z.v[k] group 2), SQL over x, the value, for a match that counts.

    Runs under the least length cannot be found by a longer repetition either, so access, hex and candidates ask for
    it in the pattern; for assign, a short value still uses up its match.
    """
    return [
        ("assign", f"(?i){ASSIGN}", "2", f"length(x) >= {ASSIGN_MIN}"),
        ("access", ACCESS[:-1] + f"{{{ACCESS_MIN - 4},}}+", "0", "true"),
        ("hex", HEX[:-1] + f"{{{HEX_MIN},}}+", "0", "true"),
        ("random", "[A-Za-z0-9+/_=-]{%d,}+" % CANDIDATE_MIN, "0", _random(table)),
    ]


_SPAN = "ARRAY<STRUCT<s: BIGINT, e: BIGINT>>"
#: Running sums are taken in blocks of this many matches, so that arrays grow in short steps.
_BLOCK = 256


def _spans(pattern: str, group: str, counts: str) -> Column:
    """Spans of the matches that count: lengths of the text between matches and of the matches, summed up."""
    p = _sql(pattern)
    steps = f"transform(z.m, (y, k) -> struct(CAST(length(z.g[k]) AS BIGINT) AS a, CAST(length(y) AS BIGINT) AS b, transform(array(z.v[k]), x -> {counts})[0] AS ok))"
    walk = f"""
      transform(array({steps}), t ->
        transform(array(transform(sequence(0, (size(t) - 1) div {_BLOCK}), j -> slice(t, CAST(j AS INT) * {_BLOCK} + 1, {_BLOCK}))), bs ->
          transform(array(aggregate(bs, struct(CAST(array() AS ARRAY<BIGINT>) AS o, 0L AS at),
              (acc, b) -> struct(concat(acc.o, array(acc.at)) AS o, acc.at + aggregate(b, 0L, (s, y) -> s + y.a + y.b) AS at), acc -> acc.o)), o ->
            flatten(transform(bs, (b, j) -> aggregate(b, struct(CAST(array() AS {_SPAN}) AS o, o[j] AS at),
              (acc, y) -> struct(IF(y.ok, concat(acc.o, array(struct(acc.at + y.a AS s, acc.at + y.a + y.b AS e))), acc.o) AS o, acc.at + y.a + y.b AS at),
              acc -> acc.o))))[0])[0])[0]"""
    values = f"regexp_extract_all(__t, {p}, {group})"
    return F.expr(f"IF(__t RLIKE {p}, transform(array(struct(split(__t, {p}, -1) AS g, regexp_extract_all(__t, {p}, 0) AS m, {values} AS v)), z -> {walk})[0], CAST(array() AS {_SPAN}))")


def scan(df: DataFrame, text_col: str = "text", table: list[int] | None = None) -> DataFrame:
    """df with `spans`: array of (kind, start, end) in code points, end exclusive, by start and then kind as assign, access, hex, random.

    Random strings are added where no base span overlaps them. A null text counts as empty; rows are judged one by
    one, in one narrow map; a column of df named spans is replaced.
    """
    table = table or train(labelled_samples())
    kinds = _kinds(table)
    one = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    one = one.withColumns({f"__{k}": _spans(p, g, ok) for k, p, g, ok in kinds})
    base = ", ".join(f"transform(__{k}, x -> struct(x.s AS s, {i} AS k, x.e AS e))" for i, (k, *_) in enumerate(kinds[:3]))
    one = one.withColumn("__base", F.expr(f"concat({base})"))
    added = "transform(filter(__random, x -> NOT exists(__base, b -> b.s < x.e AND x.s < b.e)), x -> struct(x.s AS s, 3 AS k, x.e AS e))"
    names = "array('assign', 'access', 'hex', 'random')"
    return one.withColumn("spans", F.expr(f"transform(sort_array(concat(__base, {added})), x -> struct({names}[x.k] AS kind, x.s AS start, x.e AS end))")).drop("__t", "__base", *[f"__{k[0]}" for k in kinds])


def oracle(table: list[int] | None = None) -> str:
    """DuckDB SQL of the digests, by the same table of ratios."""
    size = len(ALPHABET)
    codes = [ALPHABET.find(chr(c)) for c in range(128)]
    table = table or train(labelled_samples())
    kinds = [("assign", f"(?i){ASSIGN}", 2, f"length(v[i]) >= {ASSIGN_MIN}"), ("access", ACCESS, 0, f"length(m[i]) >= {ACCESS_MIN}"), ("hex", HEX, 0, f"length(m[i]) >= {HEX_MIN}")]
    kinds.append(("random", "[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_MIN, 0, f"list_sum(list_transform(range(1, length(m[i])), lambda k: tab[cod[ascii(substr(m[i], k, 1)) + 1] * {size} + cod[ascii(substr(m[i], k + 1, 1)) + 1] + 1])) >= {THRESHOLD} * (length(m[i]) - 1)"))
    q = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, r, k, s, s + length(m[i]) AS e FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, r, {n} AS k, string_split_regex(t, {q(p)}) AS g, regexp_extract_all(t, {q(p)}, 0) AS m, regexp_extract_all(t, {q(p)}, {v}) AS v, tab, cod FROM d, tabs))) WHERE {ok}"""
        for n, (_, p, v, ok) in enumerate(kinds)
    )
    return f"""
    WITH tabs AS (SELECT {table} AS tab, {codes} AS cod), d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
    a AS ({parts}), b AS (SELECT * FROM a WHERE k < 3),
    f AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = a.r AND b.s < a.e AND a.s < b.e)),
    o AS (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS x FROM f)
    SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans
    FROM d LEFT JOIN o USING (r) GROUP BY d.doc_id, r"""


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    text = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    base = F.expr(text.format("filter(spans, x -> x.kind <> 'random')"))
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "<SECRET>", table: list[int] | None = None) -> DataFrame:
    """df with the secrets of text_col replaced by mark: of an assignment the value, of other kinds all. Null text stays null.

    Kind after kind, the text between matches and the matches, replaced or not, are put together again: linear in the text.
    """
    own = F.col(text_col)
    for kind, pattern, group, counts in _kinds(table or train(labelled_samples())):
        p = _sql(pattern)
        part = "concat(left(z.m[k], length(z.m[k]) - length(z.v[k])), '%s')" % mark if kind == "assign" else f"'{mark}'"
        joined = f"""transform(array(struct(split(__r, {p}, -1) AS g, regexp_extract_all(__r, {p}, 0) AS m, regexp_extract_all(__r, {p}, {group}) AS v)), z ->
          array_join(transform(z.g, (y, k) -> IF(k < size(z.m), concat(y, IF(transform(array(z.v[k]), x -> {counts})[0], {part}, z.m[k])), y)), ''))[0]"""
        df = df.withColumn("__r", own).withColumn("__r", F.expr(f"IF(__r RLIKE {p}, {joined}, __r)")).withColumn(text_col, F.col("__r")).drop("__r")
    return df
