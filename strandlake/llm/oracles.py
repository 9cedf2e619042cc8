"""DuckDB SQL for the queries that SQL can express; parameters are those of the queries."""
from strandlake.llm.divergence import CLASSES, COMMON_WORDS, N_WORDS, Limits
from strandlake.llm.hash_tree import Tree, even_tree, grown
from strandlake.llm.line_spread import Spread

SPACE = r"[\x20\x09-\x0D]"


def _tree_nodes(tree: Tree, name: str) -> str:
    weight = lambda rack: sum(rack.values())
    rows = [(0, "", r, str(r), sum(map(weight, region))) for r, region in enumerate(tree)]
    rows += [(1, str(r), k, f"{r}/{k}", weight(rack)) for r, region in enumerate(tree) for k, rack in enumerate(region)]
    rows += [(2, f"{r}/{k}", s, f"{r}/{k}/{s}", w) for r, region in enumerate(tree) for k, rack in enumerate(region) for s, w in rack.items()]
    values = ", ".join(f"({d}, '{p}', {n}, '{path}', {w})" for d, p, n, path, w in rows)
    return f"{name}(depth, parent, n, path, weight) AS (VALUES {values})"


def _descend(nodes: str, name: str) -> str:
    score = "-ln((('0x' || substr(md5(key || '/' || path), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight::DOUBLE"
    steps, before = [], "SELECT doc_id, key, '' AS node FROM keys"
    for depth, out in ((0, f"{name}_r"), (1, f"{name}_k")):
        steps.append(f"{out} AS (SELECT doc_id, key, arg_min(path, {score}) AS node FROM ({before}) d JOIN {nodes} ON depth = {depth} AND parent = node GROUP BY doc_id, key)")
        before = f"SELECT doc_id, key, node FROM {out}"
    steps.append(f"{name} AS (SELECT doc_id, arg_min(n, {score}) AS shard FROM ({before}) d JOIN {nodes} ON depth = 2 AND parent = node GROUP BY doc_id)")
    return ", ".join(steps)


def _crc_step() -> str:
    """CRC-32 of one byte, four bits at a time; the table follows from the reflected polynomial."""
    half = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        half.append(n)
    table = "[" + ", ".join(f"{x}::BIGINT" for x in half) + "]"
    step = lambda c: f"xor(({c}) >> 4, {table}[(({c}) & 15) + 1])"
    return step(step("xor(c, b)"))


OP1 = """
WITH ends AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id),
kept AS (SELECT c.conv_id, c.turn, c.role, c.text, e.last,
        max(row(c.turn, c.role, c.text)) FILTER (c.turn < e.last) OVER (PARTITION BY c.conv_id) AS b FROM conversations c JOIN ends e USING (conv_id)),
sides AS (SELECT *, coalesce(CASE WHEN turn = last THEN coalesce(b[3], '') ELSE text END, '') AS echo FROM kept WHERE last IS NULL OR turn <= last),
marked AS (SELECT *, coalesce(min(CASE WHEN text IS DISTINCT FROM echo THEN turn END) OVER (PARTITION BY conv_id), 1000000) AS split,
        '<|' || role || '|>' || chr(10) AS head FROM sides),
parts AS (SELECT *, head || text || '<|end|>' || chr(10) AS a, head || echo || '<|end|>' || chr(10) AS r,
        repeat('0', length(head)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text) + 8) AS am,
        repeat('0', length(head)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(echo) + 8) AS rm FROM marked)
SELECT conv_id AS pair_id, count(*) FILTER (turn < split) AS prompt_turns, coalesce(string_agg(a, '' ORDER BY turn) FILTER (turn < split), '') AS prompt,
    coalesce(string_agg(a, '' ORDER BY turn) FILTER (turn >= split), '') AS chosen, coalesce(string_agg(am, '' ORDER BY turn) FILTER (turn >= split), '') AS chosen_mask,
    coalesce(string_agg(r, '' ORDER BY turn) FILTER (turn >= split), '') AS rejected, coalesce(string_agg(rm, '' ORDER BY turn) FILTER (turn >= split), '') AS rejected_mask
FROM parts GROUP BY conv_id
"""

_TREE = even_tree(3, 2, 4)
OP2 = f"""
WITH keys AS (SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
{_tree_nodes(_TREE, 'old_nodes')}, {_tree_nodes(grown(_TREE), 'new_nodes')},
{_descend('old_nodes', 'old_place')}, {_descend('new_nodes', 'new_place')},
bytes AS (SELECT doc_id, strlen(coalesce(text, '')) AS n,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
sums AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, b: {_crc_step()}), 4294967295::BIGINT) AS crc FROM bytes)
SELECT s.doc_id, (s.n + 8)::BIGINT AS size, s.crc AS text_crc32, 'key' AS law, o.shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY o.shard ORDER BY s.doc_id NULLS FIRST) - 1 AS slot, g.shard::INTEGER AS grown_shard
FROM sums s JOIN old_place o ON s.doc_id IS NOT DISTINCT FROM o.doc_id JOIN new_place g ON s.doc_id IS NOT DISTINCT FROM g.doc_id
"""

_S = Spread()


def line_spread(documents: str = "documents") -> str:
    """Rows of ``documents`` with ``new_text``, ``n_lines`` and ``n_removed``."""
    return f"""
SELECT d.*, c.new_text, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed FROM {documents} d LEFT JOIN (
    WITH lines AS (SELECT doc_id, coalesce(source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
            unnest(string_split(text, chr(10))) AS line FROM {documents} WHERE text IS NOT NULL),
        wide AS (SELECT line, min((doc_id, pos)) AS keep FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT site) >= {_S.min_sites}),
        marked AS (SELECT l.doc_id, l.pos, l.line, w.line IS NOT NULL AND (l.doc_id, l.pos) <> w.keep AS cut FROM lines l LEFT JOIN wide w ON l.line = w.line)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS new_text, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed
    FROM marked GROUP BY doc_id) c ON d.doc_id = c.doc_id"""


OP3 = f"SELECT doc_id, n_lines, n_removed, new_text AS text FROM ({line_spread()})"


def divergence(documents: str = "documents") -> str:
    """Base counts, ``base_failed`` and ``kept`` of each document."""
    lim = Limits()
    bins = {"c": len(CLASSES) + 1, "m": N_WORDS + 1}
    count = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
    commons = []
    for k in range(N_WORDS):
        word = "CASE lang " + " ".join(f"WHEN '{lang}' THEN '{words[k]}'" for lang, words in COMMON_WORDS.items()) + " END"
        commons.append(f"coalesce(len(list_filter(w, lambda x: lower(x) = {word})), 0) AS m{k}")
    sums = ", ".join(f"sum({x}{k}) AS r{x}{k}" for x, n in bins.items() for k in range(n))

    def distance(x: str, none: bool = False) -> str:
        n = bins[x]
        p, q = ([f"({a}{x}{k} / {a}{x}_total)" for k in range(n)] for a in ("", "r"))
        p = [f"{int(k == n - 1)}.0::DOUBLE" for k in range(n)] if none else p
        part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        return "sqrt(greatest((" + " + ".join(f"{part(a, b)} + {part(b, a)}" for a, b in zip(p, q)) + ") / 2, 0))"

    totals = ", ".join(f"nullif({' + '.join(f'{a}{x}{k}' for k in range(n))}, 0)::DOUBLE AS {a}{x}_total" for a in ("", "r") for x, n in bins.items())
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    return rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {documents}),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM base),
grams AS (SELECT doc_id, pos, {' || chr(10) || '.join(f'lead(word, {k}) OVER o' for k in range(8))} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL),
starts AS (SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS n FROM again WHERE n > 1),
repeats AS (SELECT doc_id, sum(n)::BIGINT AS n FROM starts GROUP BY doc_id),
parts AS (SELECT doc_id, lang, len(w) AS n_words, {count(SPACE).replace('length(t) - ', '')} AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t) AS n_chars,
        {count(r'\p{Lu}')} AS c0, {count('[0-9]')} AS c1, {count('[.,;:!?' + "''" + r'"()\-]')} AS c2, {count('[#*$%&|<>]')} AS c3, {count(SPACE)} AS c4, {', '.join(commons)} FROM base),
full_parts AS (SELECT *, greatest(n_chars - c0 - c1 - c2 - c3 - c4, 0) AS c5, greatest(n_words - {' - '.join(f'm{k}' for k in range(N_WORDS))}, 0) AS m{N_WORDS} FROM parts),
refs AS (SELECT lang, {sums} FROM full_parts WHERE lang IS NOT NULL GROUP BY lang),
both_parts AS (SELECT p.*, r.* EXCLUDE (lang), coalesce(s.n, 0) AS n_repeat_words, {totals} FROM full_parts p LEFT JOIN refs r ON p.lang = r.lang LEFT JOIN repeats s ON p.doc_id = s.doc_id),
judged AS (SELECT *, n_words < {lim.min_words} OR 100 * n_repeat_words > {lim.max_repeat_percent} * n_words AS base_failed,
        CASE WHEN n_chars >= {lim.min_chars} THEN {distance('c')} END AS class_distance, CASE WHEN n_words >= {lim.min_common} AND lang IN ({langs}) THEN {distance('m')} END AS word_distance, {distance('m', True)} AS none_distance FROM both_parts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(class_distance <= {lim.class_distance}, true) AND coalesce(word_distance <= {lim.word_share} * none_distance, true) AS kept
FROM judged"""


OP9 = divergence()

OP11 = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM texts LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bit, (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE instr(filter_order, l.f) < step)::INT AS prior
        FROM orders, range(1, 6) r(step), letters WHERE f = substr(filter_order, step::INT, 1)),
cells AS (SELECT part, filter_order, step, bit, n, good, toxic, fails, fails & bit <> 0 AS bad, fails & prior <> 0 AS gone FROM counts, steps)
, removed AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost FROM cells GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM removed
"""
