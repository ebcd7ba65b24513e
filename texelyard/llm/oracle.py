"""DuckDB statements of the text queries that SQL can express.

The others need a tokenizer, a seeded 64-bit hash or a trained model and are tested
against brute force.
"""

from __future__ import annotations

from texelyard.llm import hilbert, urltree
from texelyard.llm.decontam import WINDOW
from texelyard.llm.queries import URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# CRC-32 of a list of bytes by a table of 256 values.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
CRC_TABLE = f"SELECT list(v ORDER BY b) FROM (SELECT b, list_reduce(list_concat([b::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: {_STEP}) AS v FROM (SELECT unnest(range(256)) AS b))"
_WHOLE = "4294967295::UBIGINT"
CRC = f"xor(list_reduce(list_concat([{_WHOLE}], bytes), lambda c, x: xor(c >> 8, crc_of[CAST(xor(c, x) & 255 AS INTEGER) + 1])), {_WHOLE})"


def _leaks() -> str:
    words = WORDS
    return f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, coalesce({words}, []) AS words FROM documents),
  items AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS words FROM benchmark WHERE text IS NOT NULL),
  cut AS (SELECT item, words, unnest(range(greatest(1, len(words) - {WINDOW - 1}))) AS k FROM items WHERE len(words) > 0),
  windows AS (SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, array_to_string(words[k + 1:k + {WINDOW}], ' ') AS gram FROM cut),
  sizes AS (SELECT DISTINCT n FROM windows),
  spots AS (SELECT place, words, n, unnest(range(len(words) - n + 1)) AS k FROM docs, sizes WHERE len(words) >= n),
  found AS (SELECT place, k, n, item FROM (SELECT place, k, n, array_to_string(words[k + 1:k + n], ' ') AS gram FROM spots) JOIN windows USING (n, gram)),
  hit AS (SELECT place, count(DISTINCT spot) AS n_hit FROM (SELECT place, unnest(range(k, k + n)) AS spot FROM found) GROUP BY 1),
  named AS (SELECT place, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM found GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (place) LEFT JOIN named USING (place)"""


def _curve(source: str, axes: list[str], kept: str) -> str:
    """Hilbert index of integer axes, one nested SELECT per step of the transposed form."""
    bits = hilbert.BITS
    now = f"SELECT {kept}, {', '.join(f'{a} AS x{k}' for k, a in enumerate(axes))} FROM {source}"
    names = [f"x{k}" for k in range(len(axes))]

    def step(changed: dict[str, str]) -> str:
        return f"SELECT {kept}, {', '.join(f'{changed.get(n, n)} AS {n}' for n in names)} FROM ({now})"

    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for x in names:
            swap = f"(xor(x0, {x}) & {below})"
            changed = {"x0": f"CASE WHEN ({x} & {bit}) <> 0 THEN xor(x0, {below}) ELSE xor(x0, {swap}) END"}
            if x != "x0":
                changed[x] = f"CASE WHEN ({x} & {bit}) <> 0 THEN {x} ELSE xor({x}, {swap}) END"
            now = step(changed)
    for before, x in zip(names, names[1:]):
        now = step({x: f"xor({x}, {before})"})
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN ({names[-1]} & {1 << level}) <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    now = step({x: f"xor({x}, {flip})" for x in names})
    index = "0"
    for level in range(bits - 1, -1, -1):
        for x in names:
            index = f"({index} * 2 + (({x} >> {level}) & 1))"
    return f"SELECT {kept}, CAST({index} AS BIGINT) AS curve FROM ({now})"


def _shards(shards: int = 8) -> str:
    def name(column: str) -> str:
        return f"(instr('{hilbert.HEX}', substr(md5(coalesce({column}, '')), 1, 1)) - 1)"

    length = "least(length(bin(greatest(coalesce(n_chars, 0), 0) + 1)) - 1, 15)"
    return f"""
WITH crc AS MATERIALIZED (SELECT ({CRC_TABLE}) AS crc_of),
  raw AS (SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM documents),
  rows_ AS (SELECT doc_id, size, CAST({CRC} AS BIGINT) AS text_crc32, lang, source, n_chars FROM raw, crc),
  placed AS ({_curve('rows_', [name('lang'), name('source'), length], 'doc_id, size, text_crc32')}),
  ranked AS (SELECT *, row_number() OVER (ORDER BY curve, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))),
    doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM placed),
  cut AS (SELECT *, ({shards} * (r + 1) - 1) // n AS s FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard, r - (s * n) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM cut"""


def _urls() -> str:
    """The template tree of each host by a recursion over levels, and its siblings by a recursion over cuts."""
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    number = r"^[0-9]+(\.[A-Za-z0-9]+)?$"
    shape = (
        f"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), "
        f"lambda s: CASE WHEN regexp_matches(s, '{number}') THEN '*' || regexp_extract(s, '{number}', 1) ELSE s END)"
    )

    def contrast(b: str, n: str, b2: str, n2: str) -> str:
        pooled = f"(({b} + {b2}) / ({n} + {n2}))"
        spread = f"({pooled} * (1 - {pooled}) * (1.0::DOUBLE / {n} + 1.0::DOUBLE / {n2}))"
        apart = f"({b} / {n} - {b2} / {n2})"
        return f"CASE WHEN {n} > 0 AND {n2} > 0 AND {spread} > 0 THEN {apart} * {apart} / {spread} END"

    rule = verdict = ""
    for said, r in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = r.partition("/")
        rule += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}') THEN '{r}'"
        verdict += f" WHEN rule = '{r}' THEN '{said}'"
    smooth, least = urltree.SMOOTHING, urltree.SIMILAR_Z**2
    return f"""
WITH RECURSIVE links AS (SELECT page_id, url, {rest} AS rest FROM pages),
  parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM links),
  seen AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, coalesce({shape}, []) AS shape,
    try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})(\\.[A-Za-z0-9]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM parts),
  quality AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1),
  told AS (SELECT host, shape, count(quality) AS labelled, count(*) FILTER (quality = 0) AS bad FROM seen LEFT JOIN quality USING (doc_id) GROUP BY 1, 2),
  tree AS (SELECT host, shape, labelled, bad, 0 AS k, CAST([] AS VARCHAR[]) AS done FROM told
    UNION ALL
    SELECT host, shape, labelled, bad, k + 1, list_append(done, CASE WHEN n > {urltree.FANOUT} AND NOT wild AND l < {urltree.SUPPORTED}
      AND NOT (l >= {urltree.COMPARED} AND coalesce({contrast('b', 'l', '(nb - b)', '(nl - l)')} >= {least}, false)) THEN '*' ELSE seg END)
    FROM (SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, done, wild) AS n, sum(labelled) OVER (PARTITION BY host, done, wild) AS nl, sum(bad) OVER (PARTITION BY host, done, wild) AS nb,
        sum(labelled) OVER (PARTITION BY host, done, seg) AS l, sum(bad) OVER (PARTITION BY host, done, seg) AS b
      FROM (SELECT *, shape[k + 1] AS seg, starts_with(shape[k + 1], '*') AS wild FROM tree WHERE k < len(shape)))),
  grown AS (SELECT host, shape, labelled, bad, done AS template FROM tree WHERE k = len(shape)),
  summed AS (SELECT host, template, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(bad) AS BIGINT) AS bad FROM grown GROUP BY 1, 2),
  prior AS (SELECT (sum(bad) + 1) / (sum(labelled) + 2) AS p FROM summed),
  at_ AS (SELECT *, coalesce(list_max(list_filter(range(1, len(template) + 1), lambda k: NOT starts_with(template[k], '*'))), 0) AS spot,
    (bad + {smooth} * p) / (labelled + {smooth}) AS share FROM summed, prior),
  keyed AS (SELECT *, '/' || array_to_string(list_transform(template, lambda s, k: CASE WHEN k = spot THEN '{{}}' ELSE s END), '/') AS key FROM at_),
  cuts AS (SELECT 0 AS round, host, key, template, spot, labelled, bad, share, '' AS part FROM keyed WHERE labelled > 0
    UNION ALL
    SELECT round + 1, host, key, template, spot, labelled, bad, share, CASE WHEN best >= {least} THEN part || CASE WHEN place > cut THEN '1' ELSE '0' END ELSE part END
    FROM (SELECT *, max(best) OVER () AS most FROM (
      SELECT *, min(CASE WHEN q = best THEN place END) OVER (PARTITION BY host, key, part) AS cut FROM (
        SELECT *, max(q) OVER (PARTITION BY host, key, part) AS best FROM (
          SELECT *, {contrast('b', 'n', '(tb - b)', '(tn - n)')} AS q FROM (
            SELECT *, row_number() OVER up AS place, sum(labelled) OVER up AS n, sum(bad) OVER up AS b, sum(labelled) OVER (PARTITION BY host, key, part) AS tn, sum(bad) OVER (PARTITION BY host, key, part) AS tb
            FROM cuts WINDOW up AS (PARTITION BY host, key, part ORDER BY share, template ROWS UNBOUNDED PRECEDING))))))
    WHERE most >= {least}),
  parted AS (SELECT host, key, template, spot, labelled, bad, part FROM cuts WHERE round = (SELECT max(round) FROM cuts)
    UNION ALL SELECT host, key, template, spot, labelled, bad, NULL FROM keyed WHERE labelled = 0),
  pure AS (SELECT host, key, part, (CAST(sum(bad) AS BIGINT) + {smooth} * any_value(p)) / (CAST(sum(labelled) AS BIGINT) + {smooth}) AS own,
    array_to_string(list_sort(list(DISTINCT CASE WHEN spot > 0 THEN template[spot] END)), '|') AS names FROM parted, prior GROUP BY 1, 2, 3),
  nodes AS (SELECT host, key, (CAST(sum(bad) AS BIGINT) + {smooth} * any_value(p)) / (CAST(sum(labelled) AS BIGINT) + {smooth}) AS overall FROM parted, prior GROUP BY 1, 2),
  verdicts AS (SELECT host, key, bool_and(own >= {urltree.REJECT_SHARE}) FILTER (part IS NOT NULL) AS every FROM pure GROUP BY 1, 2),
  judged AS (SELECT t.host, t.template, CASE WHEN t.spot = 0 THEN t.key ELSE replace(t.key, '{{}}', '{{' || names || '}}') END AS merged,
    CASE WHEN t.part IS NULL THEN overall ELSE own END AS purity, CASE WHEN t.part IS NULL THEN coalesce(every, false) ELSE own >= {urltree.REJECT_SHARE} END AS rejected
    FROM parted t JOIN pure u ON t.host = u.host AND t.key = u.key AND t.part IS NOT DISTINCT FROM u.part JOIN nodes n ON t.host = n.host AND t.key = n.key
    JOIN verdicts v ON t.host = v.host AND t.key = v.key),
  out_ AS (SELECT page_id, s.host, path, CASE{rule} END AS rule, merged, purity, rejected FROM seen s JOIN grown USING (host, shape) JOIN judged j ON j.host = grown.host AND j.template = grown.template)
SELECT page_id, host, path, rule, CASE{verdict} WHEN rejected THEN 'block' ELSE 'allow' END AS verdict, merged AS template, purity FROM out_"""


def _fill() -> str:
    """Outputs by substrings of code points; the text is rebuilt from the output's own sentinels."""
    def number(k: int) -> str:
        return f"CAST('0x' || substr(dice, {8 * k + 1}, 8) AS BIGINT)"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS dice FROM documents),
  drawn AS (SELECT doc_id, text, n, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 90 THEN 'plain'
      WHEN {number(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
  cut AS (SELECT *, left(text, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM drawn),
  made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM cut),
  found AS (SELECT *, string_split(output, '<P>') AS p, string_split(output, '<S>') AS s, string_split(output, '<M>') AS m FROM made)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN string_split(p[2], '<S>')[1] || m[2] || string_split(s[2], '<M>')[1]
    ELSE string_split(p[2], '<M>')[1] || m[2] || string_split(s[2], '<P>')[1] END) AS restored_sha256 FROM found"""


def _resampled() -> str:
    """Buckets of distinct features, gains of 10,000 buckets, and one ranking."""
    return f"""
WITH crc AS MATERIALIZED (SELECT ({CRC_TABLE}) AS crc_of),
  texts AS MATERIALIZED (SELECT row_number() OVER () AS place, doc_id, true AS own, coalesce({WORDS}, []) AS words FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, false, coalesce({WORDS}, []) FROM benchmark),
  features AS MATERIALIZED (SELECT place, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS feature FROM texts),
  raw AS (SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM (SELECT DISTINCT feature FROM features)),
  coded AS MATERIALIZED (SELECT feature, CAST({CRC} % 10000 AS BIGINT) AS bucket FROM raw, crc),
  placed AS MATERIALIZED (SELECT place, own, bucket FROM features JOIN coded USING (feature)),
  sums AS (SELECT count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed),
  counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed GROUP BY 1),
  gains AS (SELECT bucket, CAST(floor(1000 * ln(((c.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE) / ((c.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts c, sums a),
  weights AS (SELECT place, count(*) AS n, sum(gain) AS total FROM placed JOIN gains USING (bucket) WHERE own GROUP BY 1),
  scored AS (SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM texts LEFT JOIN weights USING (place) WHERE own),
  noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM noisy)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked"""


ORACLE: dict[str, str] = {
    "op11_fenwick_fill_middle": _fill(),
    "op12_crc_resampling": _resampled(),
    "op3_url_templates": _urls(),
    "op2_aho_decontamination": _leaks(),
    "op9_hilbert_shards": _shards(),
}
