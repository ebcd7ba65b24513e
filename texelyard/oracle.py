"""DuckDB statements that recompute every registered query."""

from __future__ import annotations

from texelyard import fixtures as fx
from texelyard.functions import rules

# -- text helpers ------------------------------------------------------------


def q(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({array(values)})[CAST(({index}) + 1 AS INTEGER)]"


def case(key: str, table: dict, default="NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"(CASE {key} {whens} ELSE {default} END)"


def isin(key: str, values) -> str:
    return f"({key} IN ({', '.join(q(v) for v in values)}))"


NAME = "regexp_extract(path, '[^/]*$')"


def name_of(path):
    return f"regexp_extract({path}, '[^/]*$')"


def stem_of(path):
    return f"regexp_replace({name_of(path)}, '^(.+)(\\.[^.]*)$', '\\1')"


def ext_of(path):
    return f"regexp_extract({name_of(path)}, '^(.+)(\\.[^.]*)$', 2)"


def file_format(path):
    return case(f"lower({ext_of(path)})", rules.FORMAT_OF_EXT, "'Unknown'")


def kind_of(path, pixel_format):
    stem = f"lower({stem_of(path)})"
    whens = " ".join(f"WHEN contains({stem}, {q(part)}) THEN {q(kind)}" for part, kind in rules.KIND_RULES)
    falls = " ".join(f"WHEN {isin(pixel_format, f)} THEN {q(k)}" for k, f in rules.KIND_OF_FORMAT.items())
    return f"(CASE {whens} {falls} ELSE {q(rules.FALLBACK_KIND)} END)"


def channel_kinds_of(path):
    stem = f"lower({stem_of(path)})"
    whens = " ".join(f"WHEN contains({stem}, {q(p)}) THEN {q(','.join(k))}" for p, k in rules.CHANNEL_KIND_RULES)
    return f"(CASE {whens} ELSE {q(','.join(rules.FALLBACK_CHANNEL_KINDS))} END)"


def is_bcn(fmt):
    return isin(fmt, rules.BYTES_PER_BLOCK)


def working(fmt):
    return f"(CASE WHEN {is_bcn(fmt)} THEN {case(fmt, rules.WORKING_FORMATS, q(rules.WORKING_FORMAT_OTHER))} ELSE {fmt} END)"


def le_hex(value):
    return f"format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', ({value}) & 255, (({value}) >> 8) & 255, (({value}) >> 16) & 255, (({value}) >> 24) & 255)"


def max_mips(w, h):
    return f"(CAST(floor(log2(greatest({w}, {h}))) AS INTEGER) + 1)"


def with_(*views: str) -> str:
    """The named views and everything they read, in order."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in views)


# -- derived views -----------------------------------------------------------

VIEWS = {
    "assets": f"""
        SELECT p_partkey AS texture_id,
          'base/meta/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '/' || replace(p_name, ' ', '_')
            || {pick(fx.SUFFIXES, 'p_partkey % 31')} || {pick(fx.EXTENSIONS, 'p_partkey % 10')} AS path,
          {pick(rules.PIXEL_FORMATS, '(p_partkey // 7) % 16')} AS pixel_format,
          CAST(power(2, p_size % 12) AS INTEGER) AS width,
          CAST(power(2, (p_size // 5) % 12) AS INTEGER) AS height,
          CAST(1 + p_partkey % 5 AS INTEGER) AS mip_count
        FROM part""",
    "listing": """
        SELECT path FROM assets
        UNION ALL SELECT replace(path, 'base/meta/', 'base/payload/') FROM assets WHERE path LIKE '%.tex' AND texture_id % 3 <> 0
        UNION ALL SELECT replace(path, 'base/meta/', 'base/paylow/') FROM assets WHERE path LIKE '%.tex' AND texture_id % 4 <> 0""",
    "entries": f"""
        SELECT path FROM listing
        WHERE {isin("lower(regexp_extract(path, '[.][^.]*$'))", rules.FORMAT_OF_EXT)}""",
    "toc": f"""
        SELECT CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name,
          {pick(fx.GROUPS, 'p_partkey % 3')} AS group_name, CAST(p_partkey AS INTEGER) AS sno
        FROM part""",
    "toc_tex": "SELECT name, sno FROM toc WHERE group_name = 'Texture' AND regexp_matches(name, '[!-~]')",
    "packed": """
        SELECT l_suppkey AS f,
          row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i,
          count(*) OVER (PARTITION BY l_suppkey) AS n, l_partkey AS sno, CAST(l_quantity * 3 AS INTEGER) AS size
        FROM lineitem""",
    "packed_start": """
        SELECT *, CAST(8 + 8 * n + 8 * (i + 1) + coalesce(sum(((size + 7) // 8) * 8) OVER (
          PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM packed""",
    "packed_last": """
        SELECT sno, f, i, start, size FROM (
          SELECT *, row_number() OVER (PARTITION BY sno ORDER BY f DESC, i DESC) AS rank FROM packed_start) WHERE rank = 1""",
    "files_last": """
        SELECT sno, f, i, start, size FROM (
          SELECT *, row_number() OVER (PARTITION BY sno ORDER BY f DESC, i DESC) AS rank FROM packed_start
          WHERE f % 13 <> 0 AND NOT (f % 7 = 0 AND i = n - 1) AND (sno + i) % 11 <> 0) WHERE rank = 1""",
    "triplet": """
        SELECT t.name || '.tex' AS name, t.sno,
          CASE WHEN t.sno % 4 = 2 THEN 'name' WHEN t.sno % 4 = 1 THEN 'id' ELSE 'packed' END AS meta_source,
          CASE WHEN t.sno % 4 = 2 THEN 'Base\\meta\\Texture\\' || t.name || '.tex' WHEN t.sno % 4 = 1 THEN 'base:meta\\' || t.sno END AS meta,
          CASE WHEN t.sno % 4 IN (0, 3) THEN p.f END AS packed_f,
          CASE WHEN t.sno % 4 IN (0, 3) THEN p.start END AS packed_start,
          CASE WHEN t.sno % 4 IN (0, 3) THEN p.size END AS packed_size,
          'base:payload\\' || t.sno AS payload,
          CASE WHEN t.sno % 3 = 0 THEN 'base:paylow\\' || t.sno END AS paylow
        FROM toc_tex t LEFT JOIN packed_last p ON p.sno = t.sno
        WHERE t.sno % 5 <> 0 AND t.sno % 23 <> 0 AND (t.sno % 4 IN (1, 2) OR p.sno IS NOT NULL)""",
    "pixels": f"""
        SELECT vec_id AS texture_id, w AS width, h AS height,
          {pick(fx.PIXEL_KINDS, '(vec_id // 4) % 4')} AS kind, {pick(rules.PIXEL_FORMATS, '(vec_id // 16) % 16')} AS pixel_format,
          0 AS mip, CAST(pos % w AS INTEGER) AS x, CAST(pos // w AS INTEGER) AS y,
          CAST(floor((CAST(embedding[pos % len(embedding) + 1] AS DOUBLE) + 1) / 2 * 255 + 0.5) AS INTEGER) AS r,
          CAST((pos * 37 + vec_id * 11) % 256 AS INTEGER) AS g, CAST((pos * pos + vec_id) % 256 AS INTEGER) AS b,
          CAST(255 - (pos * 3 + vec_id) % 64 AS INTEGER) AS a
        FROM (SELECT vec_id, embedding, w, h, unnest(range(w * h)) AS pos FROM (
          SELECT *, {pick([w for w, _ in fx.SHAPES], 'vec_id % 4')} AS w, {pick([h for _, h in fx.SHAPES], 'vec_id % 4')} AS h FROM embeddings))""",
    "stored": f"""
        SELECT vec_id AS texture_id, width, height, CAST(mip AS INTEGER) AS mip, CAST(pos % w AS INTEGER) AS x, CAST(pos // w AS INTEGER) AS y,
          CAST((pos * 5 + vec_id + mip * 70) % 256 AS INTEGER) AS r, CAST((pos * 37 + vec_id * 11 + mip) % 256 AS INTEGER) AS g,
          CAST((pos * pos + vec_id + mip * 3) % 256 AS INTEGER) AS b, CAST(255 - (pos * 3 + vec_id + mip) % 64 AS INTEGER) AS a
        FROM (SELECT *, unnest(range(w * greatest(1, height >> mip))) AS pos FROM (
          SELECT *, greatest(1, width >> mip) AS w FROM (SELECT *, CAST(unnest(range(vec_id % 3 + 1)) AS INTEGER) AS mip FROM (
            SELECT vec_id, {pick([w for w, _ in fx.SHAPES], 'vec_id % 4')} AS width, {pick([h for _, h in fx.SHAPES], 'vec_id % 4')} AS height FROM embeddings))))""",
    "pixel_assets": f"""
        SELECT vec_id AS texture_id, 'base/meta/' || label || '/img' || vec_id || {pick(["_nrm", "_orm", "_rough", "_diff"], '(vec_id // 4) % 4')}
            || {pick([".png", ".TGA", ".bmp", ".txt"], '(vec_id // 16) % 4')} AS path
        FROM embeddings""",
    "pixel_requests": f"""
        SELECT vec_id * 2 + j AS texture_id, vec_id AS vec, path, 'RGBA8' AS pixel_format, CAST(vec_id % 3 + 1 AS INTEGER) AS mip_count,
          {pick([w for w, _ in fx.SHAPES], 'vec_id % 4')} AS width, {pick([h for _, h in fx.SHAPES], 'vec_id % 4')} AS height
        FROM (SELECT vec_id, unnest([0, 1]) AS j FROM embeddings) JOIN pixel_assets ON texture_id = vec_id""",
    "bitmaps": """
        SELECT vec_id, embedding, vec_id % 10 AS slot,
          'img' || vec_id || CASE vec_id % 10 WHEN 7 THEN '.png' WHEN 8 THEN '.dds' WHEN 9 THEN '.BMP' ELSE '.bmp' END AS name
        FROM embeddings""",
    "loads": f"""
        SELECT texture_id, {file_format('path')} AS file_format, texture_id % 4 <> 0 AS has_result, texture_id % 3 = 0 AS noisy,
          texture_id % 7 = 0 AS from_buffer, texture_id % 2 = 0 AND {file_format('path')} = 'TEX' AS d4
        FROM assets""",
    "judged": """
        SELECT *, file_format <> 'Unknown' AND has_result AND NOT (strict AND noisy) AS success FROM (
          SELECT *, d4 OR (file_format IN ('DDS', 'TEX') AND NOT from_buffer) AS strict FROM loads)""",
    "told": """
        SELECT texture_id, success, CASE
          WHEN file_format = 'Unknown' THEN ['Unsupported input format'] WHEN success THEN []
          WHEN noisy THEN ['bad mip', 'row ' || texture_id] WHEN d4 THEN ['The split TEX parser gave no result']
          WHEN strict THEN [] ELSE ['The ' || file_format || ' parser gave no result'] END AS issues
        FROM judged""",
    "blobs": f"""
        SELECT l_orderkey AS f, l_partkey, l_suppkey, l_linenumber % 3 + 1 AS k, CAST(l_quantity AS INTEGER) % 20 + 4 AS size_a, (CAST(l_quantity AS INTEGER) + 3) % 20 + 4 AS size_b,
          CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE {rules.PACKED_MAGIC} END AS magic,
          CASE WHEN l_partkey % 19 = 0 THEN 'five' WHEN l_partkey % 17 = 0 THEN 'twelve' WHEN l_partkey % 7 = 0 THEN 'short' ELSE 'whole' END AS cut
        FROM lineitem""",
}

PIXEL = "texture_id, width, height, mip, x, y, r, g, b, a"


def _pixels(r="r", g="g", b="b", a="a", extra=""):
    return f"{with_('pixels')} SELECT texture_id, width, height, mip, x, y, {r} AS r, {g} AS g, {b} AS b, {a} AS a{extra} FROM pixels"


UNIT_Z = "CAST(floor((sqrt(greatest(0.0, 1 - (r / 255 * 2 - 1) * (r / 255 * 2 - 1) - (g / 255 * 2 - 1) * (g / 255 * 2 - 1))) + 1) / 2 * 255 + 0.5) AS INTEGER)"
SINGLE = isin("pixel_format", rules.SINGLE_CHANNEL_FORMATS)


def _u8(value):
    return f"CAST(floor(least(greatest(({value}) * 255 + 0.5, 0.0), 255.0)) AS INTEGER)"


def _levels(source: str, levels: str, normals: bool, keep="") -> str:
    """All mip levels of ``source``, each straight from level 0."""
    kept = f", {keep}" if keep else ""

    def mean(c):
        plain = f"CAST((2 * sum({c}) + count(*)) // (2 * count(*)) AS INTEGER)"
        if not normals or c == "a":
            return plain
        v = {k: f"(sum({k}) / count(*) / 255 * 2 - 1)" for k in "rgb"}
        length = f"sqrt({v['r']} * {v['r']} + {v['g']} * {v['g']} + {v['b']} * {v['b']})"
        flat = "1.0" if c == "b" else "0.0"
        unit = f"((CASE WHEN {length} > 0 THEN {v[c]} / {length} ELSE {flat} END + 1) / 2)"
        return f"CASE WHEN kind = 'Normal' AND k > 0 THEN {_u8(unit)} ELSE {plain} END"

    folded = (
        f"SELECT s.* EXCLUDE (x, y), k, least(x >> k, greatest(1, width >> k) - 1) AS x, least(y >> k, greatest(1, height >> k) - 1) AS y "
        f"FROM {source} s, range(0, 12) t(k) WHERE k < {levels}"
    )
    values = ", ".join(f"{mean(c)} AS {c}" for c in "rgba")
    kind = ", kind" if normals and "kind" not in keep else ""
    return (
        f"SELECT texture_id, width, height, CAST(k AS INTEGER) AS mip, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {values}{kept} "
        f"FROM ({folded}) GROUP BY texture_id, width, height, k, x, y{kept}{kind}"
    )


def _down(source, k, normals=False, keep=""):
    """Level ``k`` of ``source`` as a new level 0."""
    kept = f", {keep}" if keep else ""
    chain = _levels(f"(SELECT * FROM {source} WHERE (width >> {k}) >= 1 AND (height >> {k}) >= 1)", f"{k + 1}", normals, keep)
    return (
        f"SELECT texture_id, CAST(width >> {k} AS INTEGER) AS width, CAST(height >> {k} AS INTEGER) AS height, 0 AS mip, x, y, r, g, b, a{kept} "
        f"FROM ({chain}) WHERE mip = {k}"
    )


def _dropped(source, k, left):
    """:func:`_down` with the ``left`` levels that remain from level ``k`` on."""
    chain = _levels(f"(SELECT *, {left} AS lv FROM {source} WHERE (width >> {k}) >= 1 AND (height >> {k}) >= 1)", f"lv + {k}", False)
    return (
        f"SELECT texture_id, CAST(width >> {k} AS INTEGER) AS width, CAST(height >> {k} AS INTEGER) AS height, mip - {k} AS mip, x, y, r, g, b, a "
        f"FROM ({chain}) WHERE mip >= {k}"
    )


def _up(source, s, r="r", g="g", b="b", a="a"):
    return (
        f"SELECT texture_id, CAST(width * {s} AS INTEGER) AS width, CAST(height * {s} AS INTEGER) AS height, mip, "
        f"CAST(x * {s} + i % {s} AS INTEGER) AS x, CAST(y * {s} + i // {s} AS INTEGER) AS y, {r} AS r, {g} AS g, {b} AS b, {a} AS a "
        f"FROM {source}, range(0, {s * s}) t(i)"
    )


def _ceil8(value):
    return f"(({value} + 7) // 8 * 8)"


def _full(w="width", h="height"):
    return max_mips(w, h)


def _plan() -> str:
    """Batch plan of ``catalog.PLAN_SPEC``, step by step."""
    kind = kind_of("path", "pixel_format")
    return f"""{with_('assets')}, tagged AS (
        SELECT *, {file_format('path')} AS file_format, {kind} AS kind FROM assets
        WHERE {isin(file_format('path'), ['BLP', 'BMP', 'DDS', 'JPEG', 'PNG', 'TEX'])}),
      sized AS (SELECT *, (width >> 2) >= 1 AND (height >> 2) >= 1 AS success, CAST((width >> 2) * 2 AS INTEGER) AS ow, CAST((height >> 2) * 2 AS INTEGER) AS oh FROM tagged),
      chosen AS (SELECT *, CASE WHEN kind = 'Normal' THEN 8 WHEN {isin('kind', rules.CHANNEL_MAP_KINDS)} THEN 4 ELSE 7 END AS dds FROM sized),
      planned AS (SELECT texture_id, path, file_format, kind,
        CASE WHEN kind = 'Multikind' THEN {channel_kinds_of('path')} END AS channel_kinds, pixel_format, {working('pixel_format')} AS working_format,
        CASE WHEN success THEN ow END AS out_width, CASE WHEN success THEN oh END AS out_height,
        CASE WHEN success THEN least(6, {max_mips('greatest(ow, 1)', 'greatest(oh, 1)')}) END AS out_mips,
        'DDS' AS output_format, kind = 'Normal' AS invert_g, dds = 8 AS swap_ra, 'RGBA8' AS intermediate_format,
        {case('dds', rules.DDS_TARGETS)} AS target_format, {case('dds', rules.DDS_TARGETS)} <> 'RGBA8' AS needs_convert,
        'out/' || regexp_extract(path, '^base/meta/(.*)/[^/]*$', 1) || '/' || {stem_of('path')} || '.dds' AS output_path,
        success, CASE WHEN NOT success THEN {q(rules.TOO_SMALL)} END AS message
      FROM chosen)"""


def _requests(source: str = "assets") -> str:
    def some(values, step):
        return pick(values, f"(texture_id // {step}) % {len(values)}")

    n = None
    views = ("assets",) if source == "assets" else ("pixel_assets", "stored", source)
    return f"""{with_(*views)}, req AS (
      SELECT *, CASE WHEN texture_id % 3 = 0 THEN 'out/' || texture_id || {some(['.blp', '.dds', '.JPG', '.tga', '.gif'], 3)} END AS output,
        lower({some([n, '1', '2', '3', n, n], 5)}) AS blp_type, lower({some([n, 'JPEG', 'paletted', n, 'bc2', n, 'bc9', 'true_color'], 7)}) AS comp,
        lower({some([n, 'bc3n', 'BC7', 'bc6', n, 'bc4', 'bc8'], 11)}) AS dds, {some([n, n, '90', '0', ' 55x', n], 13)} AS qual,
        lower({some([n, 'Normal', n, 'multikind', 'shiny', n, n], 17)}) AS tkind, lower({some([n, 'x2', n, 'X4', n, n, 'x8'], 19)}) AS down,
        lower({some([n, 'maximum', n, 'custom', n, 'some'], 23)}) AS gen, {some([n, '3', '0', '99', 'abc'], 29)} AS cnt,
        {some([n, '', '0.5', '7', n], 31)} AS dith, (texture_id // 2) % 4 = 1 AS inv, {file_format('path')} AS input_format,
        {pick([1, 1, 2, 4], '(texture_id // 37) % 4')} AS scale
      FROM {source}),
    o1 AS (SELECT *, coalesce(output, regexp_replace(path, '\\.[^./]*$', '') || {case('input_format', rules.DEFAULT_OUTPUT_EXT, "'.dds'")}) AS output_path FROM req),
    o2 AS (SELECT *, {file_format('output_path')} AS output_format, CASE WHEN qual = '90' THEN 90 WHEN qual = ' 55x' THEN 55 WHEN qual = '0' THEN 0 END AS qnum,
        {case('comp', rules.BLP_COMPRESSION_ARGUMENTS)} AS enc, {case('dds', rules.DDS_FORMAT_ARGUMENTS)} AS dds_index, {case('tkind', rules.KIND_OF_ARGUMENT)} AS explicit_kind FROM o1),
    opts AS (SELECT *, CASE WHEN comp IS NOT NULL THEN enc WHEN output_format = 'BLP' AND qual IS NOT NULL THEN 3 ELSE 0 END AS blp_encoding,
        CASE WHEN blp_type = '1' THEN 0 ELSE 1 END AS blp_version, coalesce({case('down', rules.DOWNSCALE_ARGUMENTS)}, 0) AS levels,
        CASE gen WHEN 'maximum' THEN 1 WHEN 'custom' THEN 2 ELSE 0 END AS mode,
        CASE WHEN gen = 'custom' AND cnt = '3' THEN 3 WHEN gen = 'custom' AND cnt = '99' THEN 99 ELSE 1 END AS mcount,
        CASE WHEN input_format = 'Unknown' THEN 'input has no known format: ' || {ext_of('path')}
          WHEN output_format = 'Unknown' THEN 'output has no known format: ' || {ext_of('output_path')}
          WHEN blp_type NOT IN ('1', '2') THEN 'blp_type ''' || blp_type || ''' is not 1 or 2'
          WHEN comp IS NOT NULL AND enc IS NULL THEN 'blp_compression ''' || comp || ''' is not one of {' '.join(rules.BLP_COMPRESSION_ARGUMENTS)}'
          WHEN dds IS NOT NULL AND dds_index IS NULL THEN 'dds_format ''' || dds || ''' is not one of {' '.join(rules.DDS_FORMAT_ARGUMENTS)}'
          WHEN qnum NOT BETWEEN 1 AND 100 THEN 'jpeg_quality ''' || qual || ''' is not from 1 to 100'
          WHEN tkind IS NOT NULL AND explicit_kind IS NULL THEN 'texture_kind ''' || tkind || ''' is not one of {' '.join(rules.KIND_OF_ARGUMENT)}'
          WHEN down NOT IN ('x2', 'x4') THEN 'downscale ''' || down || ''' is not one of {' '.join(rules.DOWNSCALE_ARGUMENTS)}'
          WHEN gen NOT IN ('maximum', 'custom') THEN 'generate_mipmaps ''' || gen || ''' is not maximum or custom' END AS error FROM o2)"""


def _jobs(source: str = "assets", last: str = "") -> str:
    bcn, cur_bcn = is_bcn("pixel_format"), is_bcn("cur")
    blp = case("blp_encoding", rules.BLP_TARGETS)
    dds = case("dds_index", rules.DDS_TARGETS)
    loose = f"CASE WHEN {cur_bcn} THEN 'RGBA8' ELSE cur END"
    code = case("blp_encoding", rules.BLP_ENCODING_CODES)
    ok = "error IS NULL"
    head = f"""{_requests(source)}, j1 AS (SELECT *, coalesce(explicit_kind, {kind_of('path', 'pixel_format')}) AS jkind,
        CAST(greatest(1, width >> levels) * scale AS INTEGER) AS ow, CAST(greatest(1, height >> levels) * scale AS INTEGER) AS oh,
        greatest(1, mip_count - levels) AS dropped,
        CASE WHEN scale > 1 OR ({bcn} AND (levels > 0 OR mode <> 0)) THEN 'RGBA8' ELSE pixel_format END AS cur FROM opts),
      j2 AS (SELECT *, CASE WHEN scale = 1 THEN dropped WHEN dropped > 1 THEN dropped + CAST(log2(scale) AS INTEGER) ELSE 1 END AS stepped,
        output_format = 'BLP' AS to_blp, output_format = 'DDS' AND dds_index IS NOT NULL AS asked, output_format = 'DDS' AND dds_index IS NULL AND inv AS loose FROM j1),
      j3 AS (SELECT *, CASE WHEN to_blp THEN {blp} WHEN asked THEN {dds} WHEN loose THEN {loose} ELSE cur END AS target,
        CASE WHEN asked AND dds_index = 8 THEN 'RGBA8' WHEN (asked AND inv) OR loose THEN {loose} ELSE cur END AS edited FROM j2)"""
    plan = f"""SELECT texture_id, output_path, output_format, CASE WHEN {ok} THEN jkind END AS kind, CASE WHEN {ok} THEN ow END AS out_width, CASE WHEN {ok} THEN oh END AS out_height,
        CASE WHEN {ok} THEN CAST(CASE mode WHEN 1 THEN {max_mips('ow', 'oh')} WHEN 2 THEN least(greatest(mcount, 1), {max_mips('ow', 'oh')}) ELSE stepped END AS INTEGER) END AS out_mips,
        CASE WHEN {ok} THEN (asked OR loose) AND inv END AS invert_g, CASE WHEN {ok} THEN asked AND dds_index = 8 END AS swap_ra,
        CASE WHEN {ok} THEN edited END AS intermediate_format, CASE WHEN {ok} THEN target END AS target_format, CASE WHEN {ok} THEN edited <> target END AS needs_convert,
        CASE WHEN {ok} AND to_blp THEN CASE WHEN blp_version = 0 OR {code} IN ('JPEG', 'Palettized') THEN 'BLP1' ELSE 'BLP2' END END AS blp_container,
        CASE WHEN {ok} AND to_blp THEN {code} END AS blp_code, {ok} AS success, error FROM j3"""
    return f"{head} {last or plan}"


def _job_options() -> str:
    return _jobs(last=f"""SELECT texture_id, CASE WHEN jkind = 'Multikind' THEN {channel_kinds_of('path')} END AS channel_kinds, CAST(levels AS INTEGER) AS halve,
        CAST(scale AS INTEGER) AS scale, scale > 1 OR mode <> 0 AS anew, dith IS NOT NULL OR (to_blp AND blp_encoding = 2) AS dither,
        CASE dith WHEN '0.5' THEN 0.5::DOUBLE WHEN '7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS dither_strength, CAST(coalesce(qnum, 75) AS INTEGER) AS jpeg_quality
      FROM j3 WHERE error IS NULL""")


def _job_pixels() -> str:
    """Every request's own pixels, step by step, nothing shared."""

    def mean(c, normal):
        plain = f"CAST((2 * sum({c}) + count(*)) // (2 * count(*)) AS INTEGER)"
        if c == "a":
            return plain
        v = {k: f"(sum({k}) / count(*) / 255 * 2 - 1)" for k in "rgb"}
        length = f"sqrt({v['r']} * {v['r']} + {v['g']} * {v['g']} + {v['b']} * {v['b']})"
        unit = f"((CASE WHEN {length} > 0 THEN {v[c]} / {length} ELSE {'1.0' if c == 'b' else '0.0'} END + 1) / 2)"
        return f"CASE WHEN {normal} THEN {_u8(unit)} ELSE {plain} END"

    def fold(source, by, keys, normal):
        at = [f"least({a} >> {by}, greatest(1, {s} >> {by}) - 1)" for a, s in (("x", "w"), ("y", "h"))]
        return f"SELECT {keys}, {at[0]} AS x, {at[1]} AS y, {', '.join(f'{mean(c, normal)} AS {c}' for c in 'rgba')} FROM {source} GROUP BY {keys}, {at[0]}, {at[1]}"

    last_unused = f"ends_with({channel_kinds_of('path')}, 'Unused')"
    full = max_mips("w", "h")
    return _jobs("pixel_requests", f""", ok AS (SELECT texture_id AS request_id, vec, width AS w0, height AS h0, jkind AS kind, CAST(levels AS INTEGER) AS halve, CAST(scale AS INTEGER) AS scale, mode,
          CASE mode WHEN 1 THEN {max_mips('ow', 'oh')} WHEN 2 THEN least(greatest(mcount, 1), {max_mips('ow', 'oh')}) ELSE stepped END AS lv,
          (asked OR loose) AND inv AS green, asked AND dds_index = 8 AS swap, target, {last_unused} AS unused FROM j3 WHERE error IS NULL),
      src AS (SELECT ok.*, w0 AS w, h0 AS h, x, y, r, g, b, a FROM ok JOIN stored ON stored.texture_id = vec AND stored.mip = 0 WHERE halve > 0 OR scale > 1 OR mode <> 0),
      kept AS (SELECT *, unnest(range(lv)) AS k FROM src WHERE scale = 1 AND mode = 0),
      kept_rows AS ({fold('kept', '(halve + k)', 'request_id, w, h, halve, kind, k', "kind = 'Normal'")}),
      small AS ({fold('(SELECT * FROM src WHERE scale > 1 OR mode <> 0)', 'halve', 'request_id, w, h, kind, halve, scale, lv, unused', "kind = 'Normal' AND halve > 0")}),
      large AS (SELECT request_id, kind, lv, CAST(greatest(1, w >> halve) * scale AS INTEGER) AS w, CAST(greatest(1, h >> halve) * scale AS INTEGER) AS h,
        x * scale + i % scale AS x, y * scale + i // scale AS y, r, g, b,
        CASE WHEN scale = 1 THEN a WHEN kind <> 'Multikind' THEN 255 WHEN unused THEN 0 ELSE a END AS a FROM small, range(16) t(i) WHERE i < scale * scale),
      deep AS (SELECT *, unnest(range(least(lv, {full}))) AS k FROM large),
      deep_rows AS ({fold('deep', 'k', 'request_id, w, h, kind, k', "kind = 'Normal' AND k > 0")}),
      every AS (SELECT request_id, greatest(1, w >> halve) AS width, greatest(1, h >> halve) AS height, k AS mip, x, y, r, g, b, a FROM kept_rows
        UNION ALL SELECT request_id, w, h, k, x, y, r, g, b, a FROM deep_rows
        UNION ALL SELECT request_id, s.width, s.height, s.mip, x, y, r, g, b, a FROM ok JOIN stored s ON s.texture_id = vec WHERE halve = 0 AND scale = 1 AND mode = 0 AND s.mip < lv)
      SELECT request_id, vec AS texture_id, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(mip AS INTEGER) AS mip, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y,
        CASE WHEN swap THEN a ELSE r END AS r, CASE WHEN green THEN 255 - g ELSE g END AS g, b, CASE WHEN swap THEN r ELSE a END AS a, kind, target AS target_format
      FROM every JOIN ok USING (request_id)""")


def _written(source: str, kept: str) -> str:
    """Rows as a DDS batch writes them, with the channel edits of normal maps."""
    normal = "kind = 'Normal'"
    target = f"CASE WHEN {normal} THEN 'BC3' WHEN {isin('kind', rules.CHANNEL_MAP_KINDS)} THEN 'BC4' ELSE 'BC7' END"
    return (
        f"{kept} SELECT texture_id, width, height, mip, x, y, CASE WHEN {normal} THEN a ELSE r END AS r, CASE WHEN {normal} THEN 255 - g ELSE g END AS g, "
        f"b, CASE WHEN {normal} THEN r ELSE a END AS a, kind, {target} AS target_format FROM {source}"
    )


def _convert_keep() -> str:
    named = f"""{with_('stored', 'pixel_assets')}, named AS (SELECT texture_id, {kind_of('path', "'RGBA8'")} AS kind FROM pixel_assets
        WHERE {file_format('path')} <> 'Unknown'), src AS (SELECT s.*, n.kind FROM stored s JOIN named n USING (texture_id))"""
    return _written("src", named)


def _collisions() -> str:
    return """WITH crowd AS (SELECT vec_id AS texture_id, 'base/meta/' || (vec_id % 25) || CASE (vec_id // 25) % 3 WHEN 1 THEN '/b' ELSE '/a' END AS stem,
          'out/' || CASE (vec_id // 25) % 3 WHEN 1 THEN 'b' ELSE 'a' END || '.dds' AS output_path,
          CASE WHEN vec_id % 4 = 0 THEN 'Failed to load: ' || vec_id END AS lost FROM embeddings),
        first AS (SELECT output_path, arg_min(texture_id, (stem || '.png', texture_id)) AS won FROM crowd WHERE lost IS NULL GROUP BY 1)
      SELECT texture_id, stem || '.png' AS path, output_path, lost IS NULL AND texture_id = won AS success,
        coalesce(lost, CASE WHEN texture_id <> won THEN 'Another file has the same output path' END) AS message FROM crowd LEFT JOIN first USING (output_path)"""


def _convert() -> str:
    joined = f"""{with_('pixels', 'pixel_assets')}, named AS (SELECT texture_id, {kind_of('path', "'RGBA8'")} AS kind FROM pixel_assets
        WHERE {file_format('path')} <> 'Unknown'),
      src AS (SELECT p.* EXCLUDE (kind, pixel_format), n.kind FROM pixels p JOIN named n USING (texture_id)),
      small AS ({_down('src', 1, True, 'kind')}),
      chain AS ({_levels('small', _full(), True, 'kind')})"""
    return _written("chain", joined)


def _replaced() -> str:
    """Even ids as the later batch writes them, the others as the earlier one did."""
    return f"""{_convert()} WHERE texture_id % 2 = 0
      UNION ALL SELECT texture_id, width, height, mip, x, y, r, g, b, a, kind, 'BC7' FROM chain WHERE texture_id % 2 <> 0"""


def slice_hex(sno: str, size: str) -> str:
    """A packed entry behind its header: its id, then a fill, as many bytes as it has."""
    head = f"{le_hex(str(fx.HEADER_MAGIC))} || {le_hex('77')} || repeat('00', 8)"
    return f"{head} || substr({le_hex(sno)} || repeat('AB', CAST(greatest({size} - 4, 0) AS INTEGER)), 1, CAST(2 * {size} AS INTEGER))"


def _blob_entries() -> str:
    start = f"8 + 8 * k + 8 * (i + 1) + CASE WHEN i > 0 THEN {_ceil8('size_a')} + (i - 1) * {_ceil8('size_b')} ELSE 0 END"
    return f"""{with_('blobs')} SELECT f, CAST(i AS BIGINT) AS i, CAST(k AS BIGINT) AS n, CAST(l_partkey + least(i, 1) AS INTEGER) AS sno,
        CAST(CASE WHEN i = 0 THEN size_a ELSE size_b END AS BIGINT) AS size, CAST({start} AS BIGINT) AS start FROM blobs, range(0, 3) t(i)
      WHERE i < k AND magic = {rules.PACKED_MAGIC} AND cut NOT IN ('five', 'twelve') AND NOT (cut = 'short' AND i = k - 1) AND (l_suppkey + least(i, 1)) % 11 <> 0"""


def _tree(text: str) -> str:
    folder = rules.VIRTUAL_FOLDER
    return f"""{with_('assets', 'listing', 'entries', 'toc', 'toc_tex')},
      split AS (SELECT path, string_split(path, '/') AS seg FROM entries WHERE contains(lower(path), '{text}')),
      parts AS (SELECT path, seg, unnest(range(1, len(seg) + 1)) AS depth FROM split),
      nodes AS (SELECT array_to_string(seg[1:depth], '/') AS node_path, array_to_string(seg[1:depth - 1], '/') AS parent_path, seg[depth] AS name,
        CAST(depth AS INTEGER) AS depth, arg_min(depth = len(seg), path) AS is_file, CAST(NULL AS INTEGER) AS sno FROM parts GROUP BY 1, 2, 3, 4)
      SELECT * FROM nodes
      UNION ALL SELECT '{folder}', '', '{folder}', 1, false, NULL WHERE EXISTS (SELECT 1 FROM toc_tex)
      UNION ALL SELECT '{folder}/' || name || '.tex', '{folder}', name || '.tex', 2, true, sno FROM toc_tex WHERE contains(lower(name || '.tex'), '{text}')"""


def _display() -> str:
    kind = case(pick([*rules.KIND_OF_ARGUMENT, "shiny"], "texture_id % 20"), rules.KIND_OF_ARGUMENT)
    shown = {t: rules.DISPLAY_NAMES[t] for t in rules.DISPLAY_NAMES}
    return f"""{with_('assets')} SELECT texture_id, {file_format('path')} AS format_name, {case('pixel_format', shown['pixel_format'])} AS pixel_name,
        {case(pick(fx.TYPES, 'texture_id % 3'), shown['type'])} AS type_name, coalesce({case(kind, shown['kind'])}, 'Unknown') AS kind_name,
        {case('texture_id % 8', shown['blp_encoding'], "'Unknown'")} AS blp_name, {case('texture_id % 10', shown['dds_format'], "'Unknown'")} AS dds_name FROM assets"""


def _details() -> str:
    kind = kind_of("path", "pixel_format")
    shown = rules.DISPLAY_NAMES
    parts = {",".join(k): ", ".join(shown["kind"][c] for c in k) for _, k in rules.CHANNEL_KIND_RULES}
    return f"""{with_('assets')} SELECT path, {file_format('path')} AS file_format, width || ' x ' || height AS dimensions,
        CASE WHEN texture_id % 3 > 0 THEN CAST(texture_id % 3 + 1 AS INTEGER) END AS depth, {case(pick(fx.TYPES, 'texture_id % 3'), shown['type'])} AS type,
        {case('pixel_format', shown['pixel_format'])} AS pixel_format, {case(kind, shown['kind'])} AS kind,
        CASE WHEN {kind} = 'Multikind' THEN {case(channel_kinds_of('path'), parts)} END AS channel_kinds,
        CASE WHEN texture_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS srgb, mip_count AS mip_levels, CASE WHEN texture_id % 3 = 2 THEN 6 ELSE 1 END AS layers FROM assets"""


def _statements() -> dict[str, str]:
    a = with_("assets")
    fmt, kind = file_format("path"), kind_of("path", "pixel_format")
    tex = "lower(regexp_extract(path, '[.][^.]*$')) = '.tex'"
    comp = f"""{with_('assets', 'listing')}, meta AS (SELECT * FROM assets WHERE {tex}),
        probed AS (SELECT *, regexp_replace(path, 'meta', 'payload') AS hi, regexp_replace(path, 'meta', 'paylow') AS lo,
          regexp_replace(path, 'meta', 'payload') IN (SELECT path FROM listing) AS has_hi, regexp_replace(path, 'meta', 'paylow') IN (SELECT path FROM listing) AS has_lo FROM meta),
        resolved AS (SELECT *, CASE WHEN has_hi THEN hi WHEN has_lo THEN lo END AS payload, CASE WHEN has_hi AND has_lo THEN lo END AS paylow,
          CASE WHEN has_hi AND has_lo THEN 'both' WHEN has_hi THEN 'payload' WHEN has_lo THEN 'paylow' ELSE 'none' END AS companion FROM probed)"""
    requested = pick([*rules.KIND_OF_ARGUMENT, "shiny"], "texture_id % 20")
    override = f"coalesce(CASE WHEN texture_id % 3 = 0 THEN {case(requested, rules.KIND_OF_ARGUMENT)} END, {kind})"
    dds = f"CASE WHEN {kind} = 'Normal' THEN 8 WHEN {isin(kind, rules.CHANNEL_MAP_KINDS)} THEN 4 ELSE 7 END"
    allowed = (
        f"CASE WHEN {kind} = 'Normal' THEN {array(rules.DDS_ALLOWED_NORMAL)} WHEN {isin(kind, rules.CHANNEL_MAP_KINDS)} THEN {array(rules.DDS_ALLOWED_CHANNEL)} "
        f"ELSE {array(rules.DDS_ALLOWED_OTHER)} END"
    )
    sub = "regexp_extract(path, '^base/meta/(.*)/[^/]*$', 1)"
    half = _u8("0.5")
    multi = "kind = 'Multikind'"
    starts = with_("packed", "packed_start", "packed_last")
    trip = with_("toc", "toc_tex", "packed", "packed_start", "packed_last", "files_last", "triplet")
    plan = _plan()
    return {
        "classify_count": f"{a} SELECT {fmt} AS file_format, {kind} AS kind, count(*) AS n FROM assets GROUP BY 1, 2",
        "scan_assets": f"{with_('bitmaps')} SELECT name, CAST(CASE WHEN slot = 8 THEN 12 ELSE 246 END AS BIGINT) AS length FROM bitmaps WHERE slot <> 7",
        "load_images": f"""{with_('bitmaps')} SELECT name, 8 AS width, 8 AS height, 0 AS mip, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
            CAST(floor((CAST(embedding[pos + 1] AS DOUBLE) + 1) / 2 * 255 + 0.5) AS INTEGER) AS r, CAST((pos * 37 + vec_id * 11) % 256 AS INTEGER) AS g,
            CAST((pos * pos + vec_id) % 256 AS INTEGER) AS b, 255 AS a FROM bitmaps, range(0, 64) t(pos) WHERE slot NOT IN (7, 8)""",
        "load_outcomes": f"""{with_('bitmaps')} SELECT name, CASE slot WHEN 7 THEN 'PNG' WHEN 8 THEN 'DDS' ELSE 'BMP' END AS file_format, slot NOT IN (7, 8) AS success,
            CASE WHEN slot NOT IN (7, 8) THEN 8 END AS width, CASE WHEN slot NOT IN (7, 8) THEN 8 END AS height,
            CASE WHEN slot = 7 THEN 'The PNG parser gave no result' ELSE '' END AS issues FROM bitmaps""",
        "filter_formats": f"{a} SELECT texture_id, path FROM assets WHERE {isin(fmt, ['DDS', 'JPEG', 'TEX'])}",
        "supported_listing": f"{with_('assets', 'listing', 'entries')} SELECT path FROM entries ORDER BY path",
        "toc_textures": f"{with_('toc', 'toc_tex')} SELECT name, sno FROM toc_tex ORDER BY name, sno",
        "packed_files": f"""SELECT path FROM (SELECT {pick(['base:', 'base' + chr(92), 'data/x/', ''], 'p_partkey % 4')}
            || {pick(['Texture', 'Material', 'Texture'], '(p_partkey // 4) % 3')} || '-' || p_partkey || {pick(['-a', '-0xBEEF', '', '-0x', '-x-y-z'], '(p_partkey // 12) % 5')}
            || CASE WHEN p_partkey % 11 = 0 THEN '.bin' ELSE '.dat' END AS path, (p_partkey // 4) % 3 AS grp, (p_partkey // 12) % 5 AS tail, p_partkey FROM part)
            WHERE grp <> 1 AND tail NOT IN (1, 2) AND p_partkey % 11 <> 0""",
        "packed_index": _blob_entries(),
        "packed_slices": f"""WITH entries_ AS ({_blob_entries()}), won AS (SELECT sno, arg_max((f, i, start, size), (f, i, start, size)) AS w FROM entries_ GROUP BY 1)
            SELECT e.sno, {le_hex(str(fx.HEADER_MAGIC))} || {le_hex('77')} || repeat('00', 8) || {le_hex('e.sno')} || repeat('AB', CAST(e.size - 4 AS INTEGER)) AS data
            FROM entries_ e JOIN won ON e.sno = won.sno AND e.f = w[1] AND e.i = w[2]""",
        "ranged_slices": f"""{with_('packed', 'packed_start', 'files_last')} SELECT CAST(sno AS INTEGER) AS sno, {slice_hex('sno', 'size')} AS data FROM files_last""",
        "triplet_bytes": f"""{trip.replace('LEFT JOIN packed_last p', 'LEFT JOIN files_last p')},
            sized AS (SELECT CAST(p_partkey AS INTEGER) AS sno, CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size + 1 END AS length FROM part),
            made AS (SELECT t.*, length, repeat(substr({le_hex('t.sno * 257')}, 1, 2), CAST(length AS INTEGER)) AS fill FROM triplet t JOIN sized USING (sno))
            SELECT name, sno, CASE WHEN meta_source = 'packed' THEN {slice_hex('sno', 'packed_size')} ELSE fill END AS data, fill AS payload_data,
              CASE WHEN paylow IS NOT NULL THEN fill END AS paylow_data FROM made""",
        "unreadable_files": f"""{with_('assets', 'listing')} SELECT path, '{rules.UNREADABLE}' || path AS message FROM listing WHERE length(path) % 7 = 0 OR length(path) % 5 = 0""",
        "packed_offsets": f"{starts} SELECT f, i, n, sno, size, start FROM packed_start",
        "last_writer": f"{starts} SELECT sno, f, i, start, size FROM packed_last",
        "split_rejects": f"{with_('assets', 'loads', 'judged', 'told')} SELECT texture_id, success, array_to_string(issues, '|') AS issues FROM told",
        "issue_report": f"""{with_('assets', 'loads', 'judged', 'told')} SELECT texture_id,
            'Failed to load: ' || texture_id || coalesce(array_to_string(list_transform(issues, lambda i: chr(10) || '  ' || i), ''), '') AS message FROM told WHERE NOT success""",
        "extract_slice": f"""{with_('blobs')} SELECT f, l_partkey, {le_hex(str(fx.HEADER_MAGIC))} || {le_hex('l_partkey * 1000')} || repeat('00', 8)
            || CASE WHEN cut = 'five' THEN '' ELSE {le_hex('l_partkey')} END || CASE WHEN cut IN ('five', 'twelve') THEN '' ELSE {le_hex('size_a')} END AS data FROM blobs""",
        "strip_header": f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND 18 + p_partkey % 5 > 16 THEN substr(whole, 33) ELSE whole END AS data FROM (SELECT p_partkey,
            {le_hex(f'CASE WHEN p_partkey % 2 = 0 THEN {fx.HEADER_MAGIC} ELSE p_partkey END')} || repeat('00', CAST(10 + p_partkey % 5 AS INTEGER)) || {le_hex('p_partkey')} AS whole FROM part)""",
        "write_converted": f"{with_('pixels')} SELECT pixel_format AS target_format, count(*) AS pixels FROM pixels GROUP BY 1",
        "path_parts": f"""{a} SELECT texture_id, lower({stem_of('path')}) AS stem, lower({ext_of('path')}) AS ext, lower(regexp_extract(path, '[.][^.]*$')) AS entry_ext,
            {NAME} AS base_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM assets""",
        "classify_format": f"{a} SELECT texture_id, {fmt} AS file_format, {case(fmt, rules.DEFAULT_OUTPUT_EXT, q('.dds'))} AS default_ext FROM assets",
        "guess_kind": f"{a} SELECT texture_id, {kind} AS kind FROM assets",
        "channel_kinds": f"{a} SELECT texture_id, {channel_kinds_of('path')} AS channel_kinds FROM assets",
        "parse_kind": f"""{a} SELECT texture_id, {requested} AS argument, {case(requested, rules.KIND_OF_ARGUMENT)} AS kind,
            {case(requested, rules.KIND_OF_ARGUMENT)} IS NULL AS rejected FROM assets""",
        "apply_kind": f"{a} SELECT texture_id, {override} AS kind, CASE WHEN {override} = 'Multikind' THEN {channel_kinds_of('path')} END AS channel_kinds FROM assets",
        "display_names": _display(),
        "plan_output": f"{a} SELECT texture_id, 'out/' || {sub} || '/' || {stem_of('path')} || '.dds' AS kept_layout, 'out/' || {stem_of('path')} || '.png' AS flat FROM assets",
        "output_collisions": f"""{a} SELECT texture_id, 'out/' || texture_id % 50 || '.tex' AS output_path, row_number() OVER (PARTITION BY texture_id % 50
            ORDER BY regexp_replace(path, '/([^/]*)$', '/' || texture_id || '_' || '\\1')) > 1 AS is_duplicate FROM assets""",
        "format_predicates": f"""{a} SELECT texture_id, {isin(kind, rules.CHANNEL_MAP_KINDS)} AS is_channel_map, {is_bcn('pixel_format')} AS is_bcn,
            {case('pixel_format', rules.WORKING_FORMATS, q(rules.WORKING_FORMAT_OTHER))} AS working_format FROM assets""",
        "clamp_options": f"""{a} SELECT texture_id, CAST(CASE WHEN texture_id % 2 = 0 THEN CASE WHEN texture_id % 9 IN (2, 3) THEN texture_id % 9 ELSE 2 END
            ELSE CASE WHEN texture_id % 9 <= 6 THEN texture_id % 9 ELSE 0 END END AS INTEGER) AS blp_encoding,
            CAST(CASE WHEN list_contains({allowed}, texture_id % 10) THEN texture_id % 10 ELSE 0 END AS INTEGER) AS dds_format FROM assets""",
        "plan_blp": f"""{a} SELECT texture_id, 'BLP2' AS blp_version, 'DXT' AS blp_encoding, 'BC2' AS target_format, pixel_format <> 'BC2' AS needs_convert, true AS dither, 75 AS jpeg_quality FROM assets
            UNION ALL SELECT texture_id, 'BLP1', 'JPEG', 'RGBA8', pixel_format <> 'RGBA8', false, 90 FROM assets""",
        "plan_dds": f"""{a} SELECT texture_id, {dds} AS dds_format, {kind} = 'Normal' AS invert_g, {kind} = 'Normal' AS swap_ra,
            CASE WHEN {kind} = 'Normal' THEN 'RGBA8' ELSE pixel_format END AS intermediate_format, {case(dds, rules.DDS_TARGETS)} AS target_format,
            CASE WHEN {kind} = 'Normal' THEN true ELSE pixel_format <> {case(dds, rules.DDS_TARGETS)} END AS needs_convert FROM assets""",
        "resolve_options": f"""{_requests()} SELECT texture_id, input_format, output_path, output_format, blp_version, blp_encoding,
            dith IS NOT NULL OR (output_format = 'BLP' AND coalesce(blp_encoding = 2, false)) AS dither, CASE dith WHEN '0.5' THEN 0.5::DOUBLE WHEN '7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS dither_strength,
            dds_index, coalesce(inv, false) AS dds_invert_y, CASE WHEN qual IS NOT NULL THEN qnum ELSE 75 END AS jpeg_quality, explicit_kind, levels AS downscale_levels,
            mode AS mipmap_mode, mcount AS mipmap_count, error FROM opts""",
        "convert_jobs": _jobs(),
        "convert_jobs_pixels": _job_pixels(),
        "convert_jobs_options": _job_options(),
        "effective_mips": f"{a} SELECT texture_id, 0 AS kept, {max_mips('width', 'height')} AS full, least(greatest(mip_count * 3 - 3, 1), {max_mips('width', 'height')}) AS custom FROM assets",
        "mip_geometry": f"""{a} SELECT texture_id, CAST(mip AS INTEGER) AS mip, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CAST(CASE WHEN {is_bcn('pixel_format')}
            THEN ((w + 3) // 4) * ((h + 3) // 4) * {case('pixel_format', rules.BYTES_PER_BLOCK, 0)} ELSE w * h * {case('pixel_format', rules.BYTES_PER_PIXEL, 0)} END AS BIGINT) AS bytes
            FROM (SELECT *, greatest(1, width >> mip) AS w, greatest(1, height >> mip) AS h FROM (SELECT *, unnest(range(mip_count)) AS mip FROM assets))""",
        "can_downscale": f"{a} SELECT texture_id, width >= 2 AND height >= 2 AS x2, width >= 4 AND height >= 4 AS x4 FROM assets",
        "upscale_geometry": f"{a} SELECT texture_id, width * 3 AS width, height * 3 AS height, CASE WHEN mip_count > 1 THEN mip_count + 1 ELSE 1 END AS mip_count FROM assets",
        "review_flags": f"""{comp}, flagged AS (SELECT *, CASE WHEN texture_id % 3 = 0 THEN 'BC3' ELSE pixel_format END AS pf FROM resolved)
            SELECT texture_id, pf = 'BC3' AND {kind_of('path', 'pf')} = 'Normal' AS needs_bc3n,
            texture_id % 5 <> 0 AND companion = 'none' AND texture_id % 2 <> 0 AS needs_payload FROM flagged""",
        "search": f"{a} SELECT texture_id, path FROM assets WHERE contains(lower(path), 'brand_1')",
        "replace_meta": f"""{a} SELECT texture_id, CASE WHEN contains(p, 'meta') THEN regexp_replace(p, 'meta', 'payload') ELSE '' END AS payload
            FROM (SELECT texture_id, CASE WHEN texture_id % 4 = 0 THEN replace(path, 'meta', 'm') ELSE path END AS p FROM assets)""",
        "resolve_companions": f"{comp} SELECT texture_id, payload, paylow, companion FROM resolved",
        "scan_all": f"""SELECT {pick(fx.TREE, 'vec_id % 5')} || vec_id || {pick(fx.TREE_EXTENSIONS, '(vec_id // 5) % 4')} AS name, CAST(vec_id % 7 AS BIGINT) AS length FROM embeddings""",
        "supported_listing_ranked": f"{with_('assets', 'listing', 'entries')} SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM entries",
        "load_attempts": f"""{comp}, told AS (SELECT *, texture_id % 5 <> 0 AND companion <> 'none' AS split FROM resolved)
            SELECT texture_id, CASE WHEN split THEN 'split' ELSE 'plain' END AS load_as, CASE WHEN split THEN payload END AS payload, CASE WHEN split THEN paylow END AS paylow FROM told""",
        "resolve_triplet": f"{trip} SELECT * FROM triplet",
        "unavailable_assets": f"{trip} SELECT sno, 'Skipped (encrypted or unavailable): ' || name AS message FROM toc_tex WHERE sno NOT IN (SELECT sno FROM triplet)",
        "group_format_hash": f"{with_('toc', 'packed', 'packed_start', 'packed_last')} SELECT sno, size, (SELECT max(sno) FROM toc WHERE group_name = 'Texture') AS format_hash FROM packed_last",
        "carry_metadata": f"""{a} SELECT texture_id, width * 2 AS width, height * 2 AS height, {kind} AS kind, texture_id % 2 = 0 AS srgb,
            CASE WHEN {kind} = 'Multikind' THEN {channel_kinds_of('path')} END AS channel_kinds FROM assets""",
        "swap_channels": _pixels(r="a", a="r"),
        "invert_channel": _pixels(g="255 - g"),
        "bc3n_pack": _pixels(r="a", g="255 - g", a="r"),
        "bc3n_pack_plain": _pixels(r="a", a="r"),
        "bc3n_unpack": _pixels(r="a", g="255 - g", a="r"),
        "channel_filter_one": _pixels(r="g", b="g", a="255"),
        "channel_filter_some": _pixels(g="0", a="255"),
        "expand_display": _pixels(g=f"CASE WHEN {SINGLE} THEN r ELSE g END", b=f"CASE WHEN {SINGLE} THEN r ELSE b END"),
        "expand_normal": _pixels(b=f"CASE WHEN kind = 'Normal' THEN {UNIT_Z} ELSE b END"),
        "display_texture": _pixels(
            g=f"CASE WHEN kind <> 'Normal' AND {SINGLE} THEN r ELSE g END",
            b=f"CASE WHEN kind = 'Normal' THEN {UNIT_Z} WHEN {SINGLE} THEN r ELSE b END",
        ),
        "fill_unused_each": _pixels(a=f"CASE WHEN {multi} THEN 191 ELSE a END"),
        "fill_unused": _pixels(a=f"CASE WHEN {multi} THEN {half} ELSE a END"),
        "quantize_u8": f"{with_('pixels')} SELECT texture_id, x, y, {_u8('(CAST(r AS DOUBLE) * 1.5 - g) / 255')} AS value FROM pixels",
        "grey_reduce": f"{with_('pixels')} SELECT texture_id, x, y, CAST((r + g + b + 1) // 3 AS INTEGER) AS grey FROM pixels",
        "upscale_x2": f"{with_('pixels')} {_up('pixels', 2, a=f'CASE WHEN {multi} THEN 0 ELSE 255 END')}",
        "upscale_x3_alpha": f"{with_('pixels')} {_up('pixels', 3)}",
        "mip_pyramid": f"{with_('pixels')} {_levels('pixels', _full(), False)}",
        "mip_pyramid_normal": f"{with_('pixels')} {_levels('pixels', f'least(4, {_full()})', True, 'kind')}",
        "mip_chain": f"{with_('pixels')} {_levels('pixels', _full(), False)}",
        "mip_chain_normal": f"{with_('pixels')} {_levels('pixels', f'least(4, {_full()})', True, 'kind')}",
        "downscale_x2": f"{with_('pixels')} {_down('pixels', 1)}",
        "downscale_x4": f"{with_('pixels')} {_down('pixels', 2)}",
        "select_mip": f"""{with_('pixels')}, chain AS ({_levels('pixels', f'least(5, {_full()})', False)})
            SELECT {PIXEL} FROM chain WHERE mip = least(4, {_full()} - 1)""",
        "select_stored_mip": f"{with_('stored')} SELECT {PIXEL} FROM stored WHERE mip = least(2, texture_id % 3)",
        "working_format": _pixels(g="255 - g", extra=f", pixel_format, {working('pixel_format')} AS seen_format"),
        "transform_steps": f"""{with_('pixels')}, fit AS (SELECT * FROM pixels WHERE width >= 4 AND height >= 4),
            one AS ({_down('fit', 2)}), two AS ({_up('one', 3)}) {_dropped('two', 1, f"CASE WHEN texture_id % 4 = 3 THEN 2 ELSE 1 END")}""",
        "transform_downscaled": f"{with_('pixels')} {_dropped('pixels', 1, 'greatest(texture_id % 4, 1)')}",
        "transform_upscaled": f"""{with_('pixels')}, big AS (SELECT *, CASE WHEN texture_id % 4 > 0 THEN texture_id % 4 + 2 ELSE 1 END AS lv FROM ({_up('pixels', 2, a='255')}))
            {_levels('big', 'lv', False)}""",
        "transform_status": f"""{a}, st AS (SELECT *, width >= 4 AND height >= 4 AS ok FROM assets)
            SELECT texture_id, CAST(CASE WHEN ok THEN ((width >> 2) * 3) >> 1 ELSE width END AS INTEGER) AS width,
            CAST(CASE WHEN ok THEN ((height >> 2) * 3) >> 1 ELSE height END AS INTEGER) AS height,
            CAST(CASE WHEN NOT ok THEN mip_count WHEN mip_count - 2 > 1 THEN mip_count - 2 ELSE 1 END AS INTEGER) AS mip_count,
            CASE WHEN NOT ok THEN 0 END AS failed_step, CASE WHEN NOT ok THEN {q(rules.TOO_SMALL)} END AS message FROM st""",
        "batch_plan": f"{plan} SELECT * FROM planned",
        "convert": _convert(),
        "convert_keep_mips": _convert_keep(),
        "convert_collisions": _collisions(),
        "convert_files": f"""{with_('bitmaps')} SELECT total, total AS processed, good AS success, total - good AS fail, true AS done, 1.0::DOUBLE AS fraction,
            good || ' converted, ' || (total - good) || ' failed, ' || total || ' in all' AS message
            FROM (SELECT count(*) AS total, count(*) FILTER (WHERE slot NOT IN (7, 8)) AS good FROM bitmaps)""",
        "asset_details": _details(),
        "batch_summary": f"""{plan}, r AS (SELECT CASE WHEN texture_id % 97 <> 0 THEN success END AS s FROM planned),
            c AS (SELECT count(*) AS total, count(s) AS processed, count(*) FILTER (WHERE s) AS success, count(*) FILTER (WHERE NOT s) AS fail FROM r)
            SELECT *, processed >= total AS done, CASE WHEN total > 0 THEN processed / total ELSE 0.0 END AS fraction,
            CASE WHEN processed >= total THEN success || ' converted, ' || fail || ' failed, ' || total || ' in all' END AS message FROM c""",
        "archive_summary": f"""{with_('assets', 'listing', 'entries', 'toc', 'toc_tex')}, c AS (SELECT (SELECT count(*) FROM toc_tex) AS d4, (SELECT count(*) FROM entries) AS other,
            (SELECT count(*) FROM listing) AS total) SELECT d4 + other AS supported, d4 AS d4_textures, other AS other_textures, total AS total_files,
            (d4 + other) || ' textures: ' || d4 || ' split, ' || other || ' other; ' || total || ' files in all' AS status FROM c""",
        "archive_summary_empty": f"""{with_('assets', 'listing', 'entries')}, c AS (SELECT (SELECT count(*) FROM entries) AS other, (SELECT count(*) FROM listing) AS total)
            SELECT other AS supported, 0::BIGINT AS d4_textures, other AS other_textures, total AS total_files,
            other || ' textures: 0 split, ' || other || ' other; ' || total || ' files in all' AS status FROM c""",
        "tree_nodes": _tree("r"),
        "tree_all": _tree(""),
        "recent_items": """WITH latest AS (SELECT user_id, event_type || '/' || (props->>'$.k') AS item, max(ts) AS ts FROM events GROUP BY 1, 2)
            SELECT user_id, item, CAST(position AS INTEGER) AS position, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS position FROM latest) WHERE position <= 10""",
        "union_catalog": f"""{with_('assets', 'listing', 'entries', 'toc', 'toc_tex')} SELECT path, 'file' AS origin, CAST(NULL AS INTEGER) AS sno FROM entries
            UNION ALL SELECT name || '.tex', 'toc', sno FROM toc_tex""",
    }


ORACLE = _statements()
ORACLE |= {
    # However often a batch is stopped or a table brought up to date, the result is that of one pass.
    "convert_resumed": ORACLE["convert"],
    "convert_replaced": _replaced(),
    "convert_files_resumed": ORACLE["convert_files"],
    "recent_items_merged": ORACLE["recent_items"],
    "recent_items_streamed": ORACLE["recent_items"],
}
