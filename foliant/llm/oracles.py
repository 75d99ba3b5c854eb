"""DuckDB SQL for the queries that SQL can express. It recomputes each result from the tables by itself."""

from __future__ import annotations

from foliant.llm.chat import END, START, TEXT
from foliant.llm.mixing import BLOCK_TOKENS, BUCKETS
from foliant.llm.quality import CLASSES, LEXICON, Rules
from foliant.llm.sharding import N_SLOTS

SP = r"[\x20\x09-\x0D]+"
WD = r"[^\x20\x09-\x0D]+"


def _hash60(seed: str | int, *columns: str) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15) AS BIGINT)"


def _shingles(w: str) -> str:
    return f"CASE WHEN len({w}) >= 5 THEN list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' '))) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""WITH i0 AS (SELECT item_id, regexp_extract_all({_LOW}, '{WD}') AS w FROM benchmark),
i1 AS (SELECT item_id, {_shingles('w')} AS s FROM i0), i AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i1),
d0 AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WD}') AS w FROM documents), d AS (SELECT doc_id, unnest({_shingles('w')}) AS g FROM d0)
SELECT doc_id, item_id, count(*) AS found, n AS n_shingles FROM d JOIN i USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n"""

_ESC = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]'))"
OP8 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum({len(START + TEXT + END)} + {_ESC.format('role')} + {_ESC.format('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _op1() -> str:
    rules = Rules()
    words = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in LEXICON.items()}
    every = "[" + ", ".join(f"'{w}'" for w in rules.bins) + "]"
    steps = (("c1", "t", r"\p{Ll}+"), ("c2", "c1", r"\p{L}+"), ("c3", "c2", SP), ("c4", "c3", "[0-9]+"), ("c5", "c4", """[.,;:!?''"()-]+"""), ("c6", "c5", "[!-~]+"))
    cascade = "t0 AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)"
    before = "t0"
    for name, source, pattern in steps:
        cascade += f", t{name} AS (SELECT *, regexp_replace({source}, '{pattern}', '', 'g') AS {name} FROM {before})"
        before = f"t{name}"
    counts = dict(zip(CLASSES, ("length(t) - length(c1)", "length(c1) - length(c2)", "length(c3) - length(c4)", "length(c2) - length(c3)", "length(c4) - length(c5)", "length(c5) - length(c6)", "length(c6)"), strict=True))
    classes = "[" + ", ".join(counts.values()) + "]"
    js = "sqrt(greatest(list_sum(list_transform(list_zip({0}, {1}), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)) / 2, 0))"
    near = []
    for k, ws in words.items():
        own = f"list_transform({ws}, lambda b: coalesce(len(list_filter(common, lambda x: x = b)), 0) / greatest(n_words, 1))"
        ref = f"list_transform({ws}, lambda b: coalesce((SELECT any_value(m[b]) FROM refs WHERE lang = '{k}'), 0))"
        near.append((k, own, ref))
    out = f"""WITH {cascade},
w AS (SELECT doc_id, lang, t, {classes} AS cl, regexp_extract_all(t, '{WD}') AS ws, length(c2) - length(c3) AS spaces, length(regexp_replace(c5, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM {before}),
b AS (SELECT *, len(ws) AS n_words, length(t) - spaces AS word_chars, list_filter(ws, lambda x: list_contains({every}, x)) AS common,
len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WD}')))) AS n_dup_lines FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM b WHERE len(ws) >= 3), g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE k > 1) GROUP BY 1),
lg AS (SELECT lang, cl, common, n_words FROM b WHERE n_words >= 50 AND lang IN ({', '.join(repr(k) for k in words)})),
ct AS (SELECT lang, {', '.join(f'sum(cl[{i + 1}]) AS k{i}' for i in range(len(CLASSES)))}, sum(n_words) AS total FROM lg GROUP BY lang),
cw AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(common) AS x FROM lg) GROUP BY 1, 2),
rf AS (SELECT ct.lang, [{', '.join(f'k{i}' for i in range(len(CLASSES)))}] AS k, total, coalesce(m, MAP {{}}) AS m FROM ct LEFT JOIN (SELECT lang, map_from_entries(list((x, n))) AS m FROM cw GROUP BY 1) q ON q.lang = ct.lang),
lx AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in words.items())}) v(code, lex)),
rr AS (SELECT lang, list_transform(k, lambda x: x / greatest(list_sum(k), 1)) AS qc, lex, list_transform(lex, lambda x: coalesce(m[x], 0) / total) AS qw FROM rf JOIN lx ON code = lang),
hs AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(common) AS x FROM b) GROUP BY 1, 2),
hm AS (SELECT b.doc_id, n_words, length(t) AS n_chars, list_transform(cl, lambda x: x / greatest(length(t), 1)) AS pc, coalesce(h, MAP {{}}) AS h FROM b LEFT JOIN (SELECT doc_id, map_from_entries(list((x, n))) AS h FROM hs GROUP BY 1) q ON q.doc_id = b.doc_id),
pr AS (SELECT doc_id, n_words, n_chars, pc, qc, list_transform(lex, lambda x: coalesce(h[x], 0) / greatest(n_words, 1)) AS pw, qw FROM hm, rr),
ds AS (SELECT doc_id, greatest({js.format('pc', 'qc')} / {rules.class_distance}, {js.format("list_append(pw, greatest(n_words, 1) / greatest(n_words, 1) - list_sum(pw))", "list_append(qw, 1 - list_sum(qw))")} / {rules.word_distance}) AS excess FROM pr),
dm AS (SELECT doc_id, min(excess) AS excess FROM ds GROUP BY 1),
f AS (SELECT b.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN r USING (doc_id))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (length(t) >= {rules.least_chars} AND coalesce(excess, 0) > 1) AS kept FROM f LEFT JOIN dm ON dm.doc_id = f.doc_id"""
    return out


_SEED = 7
OP5 = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WD}')) AS size, {_hash60(_SEED, 'doc_id', 'text')} AS h FROM documents),
p0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s GROUP BY source),
p1 AS (SELECT *, [3, 1, 2][(pos - 1) % 3 + 1] AS weight FROM p0), tt AS (SELECT sum(source_size) AS total FROM p0),
p2 AS (SELECT p1.*, total, coalesce(sum(2 * source_size) OVER f, 0) AS capped, (SELECT sum(weight) FROM p1) - coalesce(sum(weight) OVER f, 0) AS free FROM p1, tt WINDOW f AS (ORDER BY 2 * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p3 AS (SELECT *, 2 * source_size * free <= (1.5 * total - capped) * weight AS full_ FROM p2),
lv AS (SELECT coalesce((SELECT (1.5 * total - capped) FROM p3 WHERE NOT full_ ORDER BY 2 * source_size / weight, pos LIMIT 1), 0) AS num, coalesce((SELECT free FROM p3 WHERE NOT full_ ORDER BY 2 * source_size / weight, pos LIMIT 1), 1) AS den),
p4 AS (SELECT source, pos, source_size, CAST(CASE WHEN full_ THEN 2 * source_size ELSE num * weight / den END AS DOUBLE) AS target, CAST(ceil(source_size / {BLOCK_TOKENS}.0) AS BIGINT) AS blocks FROM p3, lv),
m AS (SELECT CAST(round_even(sum(target) / {BLOCK_TOKENS}, 0) AS BIGINT) AS n FROM p4),
qt AS (SELECT pos, target / (2 * k + 1) AS q FROM (SELECT pos, target, unnest(range(0, 2 * blocks)) AS k FROM p4 WHERE target > 0)),
st AS (SELECT pos, count(*) AS seats FROM (SELECT pos FROM qt, m QUALIFY row_number() OVER (ORDER BY q DESC, pos) <= any_value(n) OVER ()) GROUP BY 1),
pl AS (SELECT p4.*, coalesce(seats, 0) AS seats, greatest(blocks, 1) AS b, CAST('0x' || substr(md5('{_SEED}|start|' || coalesce(source, '')), 1, 15) AS BIGINT) % greatest(blocks, 1) * {BLOCK_TOKENS} AS first FROM p4 LEFT JOIN st ON st.pos = p4.pos),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM s),
j AS (SELECT o.doc_id, o.size, o.stop - o.size AS start, o.stop, pl.*, seats // b AS whole, first + (seats % b) * {BLOCK_TOKENS} AS arc, b * {BLOCK_TOKENS} AS line FROM o JOIN pl ON pl.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole * size + greatest(least(stop, least(arc, line)) - greatest(start, first), 0) + greatest(least(stop, greatest(arc - line, 0)) - start, 0) AS BIGINT) AS taken, source, seats FROM j"""


def _crc_table() -> str:
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return "[" + ", ".join(map(str, table)) + "]::BIGINT[]"


OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, {_hash60('slot', 'doc_id', 'text')} % {N_SLOTS} AS vs, hex(encode(coalesce(text, ''))) AS hx FROM documents),
k AS (SELECT {_crc_table()} AS tb),
r AS (SELECT doc_id, size, vs, xor(list_reduce(list_transform(range(0, length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, k),
sl AS (SELECT vs, sum(size) AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, vs) AS i FROM d GROUP BY vs),
ls AS (SELECT list(vs ORDER BY i) AS vss, list(bytes ORDER BY i) AS bs FROM sl),
go AS (SELECT 0 AS i, list_transform(range(0, 24), lambda x: 0::BIGINT) AS load, NULL::BIGINT AS vs, NULL::BIGINT AS shard
UNION ALL SELECT i + 1, list_transform(range(1, 25), lambda x: CASE WHEN x = list_position(load, list_min(load)) THEN load[x] + bs[i + 1]::BIGINT ELSE load[x] END), vss[i + 1], list_position(load, list_min(load)) - 1 FROM go, ls WHERE i < len(bs)),
mp AS (SELECT vs, shard FROM go WHERE vs IS NOT NULL),
bf AS (SELECT mp.vs, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY mp.vs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mp JOIN sl ON sl.vs = mp.vs)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(before + row_number() OVER (PARTITION BY r.vs ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, r.vs AS virtual_slot, 1 AS map_version FROM r JOIN bf ON bf.vs = r.vs"""

ORACLES: dict[str, str] = {"op1_distribution_divergence": _op1(), "op4_virtual_slots": OP4, "op5_sainte_lague": OP5, "op8_event_sourced_chat": OP8, "op9_minhash_containment": OP9}
