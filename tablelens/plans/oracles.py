"""The same results in DuckDB SQL, one statement per registered query."""

from __future__ import annotations

from tablelens.operators import prompts

WS = r"[\t-\r\x{85}\p{Z}]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WIDTH = 80


def sig(x: str) -> str:
    return f"cast(format('{{:.8e}}', {x}) as double)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def flat(x: str) -> str:
    return trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def wrapped(x: str, width: int) -> str:
    """Array of greedy lines, trailing blanks still on."""
    return rf"regexp_extract_all({flat(x)}, '.{{1,{width}}}(?: |$)|\S+(?: |$)')"


def wrapped_lines(x: str, width: int) -> str:
    indent = f"repeat(' ', strlen({x}) - strlen(regexp_replace({x}, '^{WS}+', '')))"
    return f"list_transform({wrapped(x, width)}, lambda l: {indent} || rtrim(l, ' '))"


def en(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '[a-zA-Z0-9]+')) as bigint)"


def han(x: str) -> str:
    return rf"cast(len(regexp_extract_all({x}, '\p{{Han}}')) as bigint)"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '[[:punct:]]', '', 'g')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- profiles ------------------------------------------------------------


def mode_text(value: str, source: str, kind: str) -> str:
    text = rf"regexp_replace(cast({value} as varchar), '\.0$', '')" if kind == "double" else f"cast({value} as varchar)"
    return (
        f"(select {text} from {source} where {value} is not null and cast({value} as varchar) <> '' "
        f"group by {value} order by count(*) desc, {value} limit 1)"
    )


def numeric_profile(name: str, source: str, kind: str, full: bool) -> str:
    value = f"case when isfinite({name}::double) then {name}::double end"
    quick = f"""
      select '{name}' as name, true as is_numeric, count(*) as count,
        count(*) filter (where c is null) as none_count,
        count(*) filter (where c is null or isnan(c::double)) as na_count,
        count(*) filter (where v = 0) as zero_count, count(*) filter (where v <> 0) as non_zero_valid_count,
        {sig('avg(v)')} as mean, {sig('min(v)')} as min, {sig('max(v)')} as max"""
    if not full:
        return quick + f" from (select {name} as c, {value} as v from {source})"
    return f"""{quick}, false as is_inferred, {sig('median(v)')} as median,
        {mode_text(name, source, kind)} as mode,
        {sig('stddev_pop(v)')} as std_dev, {sig('var_pop(v)')} as variance,
        round(case when var_pop(v) > 0 then avg(power(v - m, 3)) / power(var_pop(v), 1.5) else 0 end, 6) + 0.0 as skewness,
        round(case when var_pop(v) > 0 then avg(power(v - m, 4)) / power(var_pop(v), 2) - 3 else 0 end, 6) + 0.0 as kurtosis
      from (select {name} as c, {value} as v, avg({value}) over () as m from {source})"""


NULLS = "null::double as mean, null::double as min, null::double as max"
FULL_NULLS = (
    "null::double as std_dev, null::double as variance, null::double as skewness, null::double as kurtosis"
)


def other_profile(name: str, source: str, full: bool, text: bool) -> str:
    quick = f"""select '{name}' as name, false as is_numeric, count(*) as count,
        count(*) filter (where {name} is null) as none_count, 0::bigint as na_count,
        0::bigint as zero_count, 0::bigint as non_zero_valid_count, {NULLS}"""
    if full:
        mode = mode_text(name, source, "text") if text else "null"
        quick += f", false as is_inferred, null::double as median, {mode} as mode, {FULL_NULLS}"
    return quick + f" from {source}"


def inferred_profile(name: str, source: str) -> str:
    number = f"case when regexp_matches({trim('s')}, '{NUMBER}') then try_cast({trim('s')} as double) end"
    shown = "(sum(1) filter (where v is not null)) / (sum(1) filter (where filled)) >= 0.9"
    pick = lambda x: f"case when {shown} then {x} end"
    zero = lambda x: f"case when {shown} then {x} else 0 end"
    return f"""
      select '{name}' as name, {shown} as is_numeric, count(*) as count,
        count(*) filter (where s is null) as none_count,
        {zero('count(*) filter (where v is null)')} as na_count,
        {zero('count(*) filter (where v = 0)')} as zero_count,
        {zero('count(*) filter (where v <> 0)')} as non_zero_valid_count,
        {pick(sig('avg(v)'))} as mean, {pick(sig('min(v)'))} as min, {pick(sig('max(v)'))} as max,
        {shown} as is_inferred, {pick(sig('median(v)'))} as median,
        {mode_text(name, source, 'text')} as mode,
        {pick(sig('stddev_pop(v)'))} as std_dev, {pick(sig('var_pop(v)'))} as variance,
        {pick('round(avg(power(v - m, 3)) / power(var_pop(v), 1.5), 6) + 0.0')} as skewness,
        {pick('round(avg(power(v - m, 4)) / power(var_pop(v), 2) - 3, 6) + 0.0')} as kurtosis
      from (select *, avg(v) over () as m from
        (select s, {number} as v, {trim('s')} <> '' as filled from (select {name} as s from {source})))"""


def text_profile(name: str, source: str) -> str:
    s = f"(select {name} as s from {source} where {name} <> '')"
    word = rf"""(select word from (select regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') as word
        from (select unnest(regexp_split_to_array(s, '{WS}+')) as w from {s}))
        where word <> '' group by word order by count(*) desc, word limit 1)"""
    content = f"(select {{}} from {s} group by s order by count(*) desc, s limit 1)"
    return f"""
      select '{name}' as name, false as is_numeric, (select count(*) from {source}) as count,
        (select count(*) from {source} where {name} is null) as none_count,
        {content.format('s')} as mode,
        sum({en('s')})::bigint as en_words, sum({han('s')})::bigint as cn_chars,
        (sum({en('s')}) + sum({han('s')}))::bigint as total,
        {word} as top_freq_word, {content.format('s')} as top_content, {content.format('count(*)')} as top_n,
        (select s from {s} order by strlen(s) desc, s limit 1) as longest,
        (select s from {s} order by strlen(s), s limit 1) as shortest
      from {s}"""


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


LINEITEM = [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
]
EVENT_STRINGS = r"""(select event_id::varchar as event_id, k, ' ' || k || ' ' as padded,
    case when event_id % 20 = 0 then 'n/a' else k end as mostly,
    case when event_id % 5 = 0 then '1d' else k end as seldom,
    case when event_id % 3 <> 0 then '' else k end as gaps, event_type, '' as blank
    from (select *, regexp_extract(props, '(\d+)', 1) as k from events))"""


def string_stats(name: str, source: str, summary: bool) -> str:
    number = f"case when {name} <> '' and regexp_matches({name}, '{NUMBER}') then try_cast({name} as double) end"
    rate = "count(v) / nullif(count(*) filter (where c <> ''), 0) > 0.9"
    inner = f"(select {name} as c, {number} as v from {source})"
    filled = "count(*) filter (where c <> '')"
    if not summary:
        kind = f"case when {filled} = 0 then 'empty' when {rate} then 'numeric' else 'string' end"
        return f"select '{name}' as name, {kind} as type, count(c) as total, {filled} as non_empty from {inner}"
    pick = lambda x: f"case when {rate} then {x} end"
    text = lambda x: f"case when {rate} then null else sum({x})::bigint end"
    return f"""select '{name}' as name, case when {rate} then 'numeric' else 'string' end as type,
        {filled} as non_empty, {pick(sig('avg(v)'))} as mean, {pick('min(v)')} as min, {pick('max(v)')} as max,
        {pick('count(*) filter (where v = 0)')} as zero_count,
        {text(en('c'))} as en_words, {text(han('c'))} as cn_chars from {inner}"""


def row_stats(source: str, key: str, name: str, texts: str, numbers: str | None) -> str:
    """Row profiles from a list of texts and, for numeric rows, a list of doubles, per key."""
    if numbers:
        stats = """list_avg(l) as mean, list_median(l) as median, list_aggregate(l, 'var_pop') as variance,
          list_min(l) as min, list_max(l) as max,
          len(list_filter(l, lambda x: x = 0)) as zero_count, len(list_filter(l, lambda x: x <> 0)) as nonzero"""
        moments = """list_sum(list_transform(l, lambda x: power(x - mean, 3))) / len(l) as m3,
          list_sum(list_transform(l, lambda x: power(x - mean, 4))) / len(l) as m4"""
    else:
        stats = """null::double as mean, null::double as median, null::double as variance,
          null::double as min, null::double as max, 0 as zero_count, 0 as nonzero"""
        moments = "null::double as m3, null::double as m4"
    kind = "numeric" if numbers else "str"
    flat_row = "0" if numbers else "null"
    return f"""
    with src as (select {key} as k, cast({name} as varchar) as name, {texts} as t,
        {numbers or 'null::double[]'} as l from {source}),
      st as (select *, {stats} from src), mo as (select *, {moments} from st),
      freq as (select k, x, count(*) as n from (select k, unnest(t) as x from src) where x <> '' group by k, x),
      top as (select k, x as top_content, n as top_n from freq
        qualify row_number() over (partition by k order by n desc, x) = 1)
    select name, '{kind}' as dtype, {str(bool(numbers)).lower()} as is_numeric, cast(len(t) as bigint) as count,
      round(mean, 4) + 0.0 as mean, round(median, 4) + 0.0 as median, round(sqrt(variance), 4) + 0.0 as std_dev,
      round(variance, 4) + 0.0 as variance, round(min, 4) + 0.0 as min, round(max, 4) + 0.0 as max,
      round(case when variance > 0 then m3 / power(variance, 1.5) else {flat_row} end, 4) + 0.0 as skewness,
      round(case when variance > 0 then m4 / power(variance, 2) - 3 else {flat_row} end, 4) + 0.0 as kurtosis,
      cast(zero_count as bigint) as zero_count, cast(nonzero as bigint) as non_zero_valid_count,
      {en("array_to_string(t, ' ')")} as en_words, top_content, top_n
    from mo join top using (k)"""


# --- texts ---------------------------------------------------------------

LINES = """(select doc_id as file, u.i - 1 as line_no, u.x as line
    from documents, unnest(string_split(text, chr(10))) with ordinality as u(x, i))"""
PARAGRAPH_DOCS = "(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)"


def soft(source: str) -> str:
    """(doc_id, soft_lines) by paragraph and line."""
    return rf"""(select d.doc_id, coalesce(sum(case when {trim('line')} <> '' then len({wrapped('line', WIDTH)})
          when li > 1 then 1 else 0 end), 0)::bigint as soft_lines
      from {source} d left join (
        select doc_id, v.x as line, v.i as li from
          (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as para from {source}) p,
          unnest(string_split(regexp_replace(para, '\n$', ''), chr(10))) with ordinality as v(x, i)
        where para <> '') using (doc_id) group by d.doc_id)"""


def paragraph_rows(source: str) -> str:
    return f"""(select doc_id, row_number() over (partition by doc_id order by i) as paragraph_no, paragraph from
      (select doc_id, u.x as paragraph, u.i from {source}, unnest(string_split(text, chr(10) || chr(10)))
        with ordinality as u(x, i)) where {trim('paragraph')} <> '')"""


def paragraphs(x: str) -> str:
    return f"cast(len(list_filter(string_split({x}, chr(10) || chr(10)), lambda p: {trim('p')} <> '')) as bigint)"


TEXT_PROFILE = f"""select d.doc_id, {en('text')} as en_words, {han('text')} as cn_chars, soft_lines,
    {paragraphs('text')} as paragraphs, {en('text')} + {han('text')} as total
    from {PARAGRAPH_DOCS} d join {soft(PARAGRAPH_DOCS)} s using (doc_id)"""


def cut_cell(x: str, width: int = 10) -> str:
    return f"case when length({x}) > {width} then substr({x}, 1, {width - 3}) || '...' else {x} end"


def numbered(columns: str, source: str, order: str) -> str:
    return f"(select row_number() over (order by {order}) - 1 as \"Row\", {columns} from {source})"


# --- messages ------------------------------------------------------------

HISTORY = f"""(
  with said as (select conv_id, turn, role, {trim('text')} as content from conversations),
    pairs as (select u.conv_id, u.turn, u.content as q, a.content as r from said u join said a
      on a.conv_id = u.conv_id and a.turn = u.turn + 1
      where u.role = 'user' and a.role = 'assistant' and u.content <> '' and a.content <> '')
  select conv_id, turn, role, content from said where role = 'system'
  union all select conv_id, turn, 'user', q from pairs
  union all select conv_id, turn + 1, 'assistant', r from pairs)"""
PARAGRAPH_SYSTEM = prompts.PARAGRAPH_PROMPT.format(language="中文")
OVERVIEW_SYSTEM = prompts.OVERVIEW_PROMPT.format(language="中文")
REQUEST_START = '{"model":"model-a","messages":[{"role":"system","content":"Be brief."}'
REQUEST_END = (
    '],"stream":false,"temperature":0.3,"max_tokens":2000,"thinking":{"type":"enabled"},"reasoning_effort":"max"}'
)


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    rest = [("l_returnflag", True), ("l_linestatus", True), ("l_shipdate", False)]
    sql["profile_quick_lineitem"] = union(
        [numeric_profile(n, "lineitem", k, False) for n, k in LINEITEM]
        + [other_profile(n, "lineitem", False, t) for n, t in rest]
    )
    sql["profile_full_lineitem"] = union([numeric_profile(n, "lineitem", k, True) for n, k in LINEITEM])
    sql["profile_full_orders"] = union(
        [numeric_profile(n, "orders", k, True) for n, k in (("o_orderkey", "int"), ("o_custkey", "int"), ("o_totalprice", "double"))]
        + [other_profile(n, "orders", True, t) for n, t in (("o_orderstatus", True), ("o_orderpriority", True), ("o_orderdate", False))]
    )
    sql["profile_text_part"] = union([text_profile(n, "part") for n in ("p_name", "p_brand", "p_type")])
    sql["profile_text_documents"] = union([text_profile(n, "documents") for n in ("text", "lang", "source")])
    modes = []
    for name, kind in LINEITEM + [("l_returnflag", "text"), ("l_linestatus", "text")]:
        n = f"(select count(*) from lineitem group by {name} order by 1 desc limit 1)"
        modes.append(f"select '{name}' as name, {mode_text(name, 'lineitem', kind)} as mode, {n} as n")
    sql["mode_all_columns"] = union(modes)
    sql["inferred_numeric"] = union([inferred_profile(n, EVENT_STRINGS) for n in ("k", "padded", "mostly", "seldom", "gaps")])
    sql["top_word_by_lang"] = rf"""select lang, word, n from (
        select lang, word, count(*) as n from (select lang, regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') as word
          from (select lang, unnest(regexp_split_to_array(text, '{WS}+')) as w from documents)) where word <> '' group by lang, word)
        qualify row_number() over (partition by lang order by n desc, word) = 1"""
    sql["table_shape"] = "select count(*) as rows, 11::bigint as columns from lineitem"
    names = ["event_id", "k", "padded", "mostly", "seldom", "gaps", "event_type", "blank"]
    sql["allstring_report"] = union([string_stats(n, EVENT_STRINGS, False) for n in names])
    sql["allstring_summary"] = union([string_stats(n, EVENT_STRINGS, True) for n in names])
    values = "o_custkey, o_orderkey % 7, o_custkey % 7, o_orderkey % 3, 3"
    sql["row_profile"] = row_stats(
        "orders", "o_orderkey", "o_orderkey", f"list_transform([{values}], lambda x: cast(x as varchar))",
        f"list_transform([{values}], lambda x: cast(x as double))",
    )
    sql["row_profile_mixed"] = row_stats(
        "customer", "c_custkey", "c_name",
        "[cast(c_custkey as varchar), c_name, c_mktsegment, cast(c_nationkey as varchar)]", None,
    )
    sql["row_profile_numbered"] = row_stats(
        numbered("*", "part", "p_partkey"), "p_partkey", '"Row"',
        "[cast(p_size as varchar), cast(p_partkey as varchar)]", "[cast(p_size as double), cast(p_partkey as double)]",
    )
    count_words = lambda x: rf"len(regexp_extract_all(cast({x} as varchar), '\S+'))"
    part_words = " + ".join(count_words(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
    sql["row_fields"] = f"""select "Row", 6::bigint as fields, cast({part_words} as bigint) as words
        from {numbered('*', 'part', 'p_partkey')} where "Row" < 20"""

    sql["percent_normalise"] = """select l_orderkey, l_linenumber, cast(p as double) / 100 as discount,
        case when l_linenumber = 1 then 'none' else cast(p as varchar) || '%' end as mixed
        from (select *, cast(round(l_discount * 100) as int) as p from lineitem)"""
    sql["select_by_position"] = "select c_custkey, c_name, c_nationkey from customer"
    sql["select_by_list"] = "select c_mktsegment, c_custkey from customer"
    sql["select_by_name"] = "select c_custkey, c_acctbal from customer"
    sql["number_columns"] = "select c_custkey as c0, c_name as c1, c_nationkey as c2 from customer"
    sql["truncate_cells"] = f"select p_partkey, {cut_cell('p_name')} as p_name, {cut_cell('repeat(p_type, 3)')} as t from part"
    sql["render_tsv"] = """select c_custkey, c_custkey || chr(9) || c_name || chr(9) ||
        case when c_mktsegment = 'BUILDING' then 'null' else c_mktsegment end as line from customer"""
    sql["render_numbers"] = r"""select p_partkey, regexp_replace(cast(p_retailprice as varchar), '\.0$', '') as price,
        cast(p_partkey * 1000000000 as varchar) as large,
        rtrim(cast(cast(p_size as decimal(18, 0)) * cast('0.00000095367431640625' as decimal(20, 20)) as varchar), '0') as small
        from part"""

    three = "o_orderkey, o_custkey, o_orderstatus"
    sql["head_orders"] = f"select {three} from orders order by o_orderkey limit 5"
    sql["tail_orders"] = f"select {three} from orders order by o_orderkey desc limit 5"
    sql["head_file_order"] = """select o_orderkey, o_custkey from
        (select *, row_number() over () as i from orders) order by i limit 5"""
    sql["tail_file_order"] = """select o_orderkey, o_custkey from
        (select *, row_number() over () as i from orders) order by i desc limit 5"""
    sql["row_positions"] = "select * from " + numbered("o_orderkey, o_orderstatus", "orders", "o_orderstatus, o_orderkey")
    sql["row_positions_file"] = """select row_number() over () - 1 as "Row", l_orderkey, l_linenumber, l_extendedprice from lineitem"""
    sql["rows_range"] = f"""select * from {numbered('o_orderkey, o_totalprice', 'orders', 'o_orderkey')} where "Row" between 700 and 1200"""
    sql["rows_range_by_price"] = f"""select * from {numbered('o_totalprice, o_orderkey', 'orders', 'o_totalprice, o_orderkey')}
        where "Row" between 500 and 1000"""
    sql["rows_specific"] = f"""select ord, r.* from {numbered('o_orderkey, o_totalprice, o_orderpriority', 'orders', 'o_orderkey')} r
        join (values (0::bigint, 1400), (1, 3), (2, 3), (3, 750)) as w(ord, p) on r."Row" = w.p"""
    line_keys = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    down = ", ".join(f"{k} desc" for k in line_keys.split(", "))
    sql["head_many"] = f"select {line_keys} from lineitem order by {line_keys} limit 150000"
    sql["tail_many"] = f"select {line_keys} from lineitem order by {down} limit 150000"
    sql["rows_many"] = f"""select * from {numbered(line_keys, 'lineitem', line_keys)} where "Row" between 1000 and 190000"""
    sql["lines_missing"] = f"""select file, p as line_no, lines from (select file, count(*) as lines from {LINES} group by file),
        (values (0::bigint), (3), (20)) as w(p) where p >= lines"""
    sql["rows_missing"] = """select p as "Row", total from (values (3::bigint), (1000000000000)) as w(p),
        (select count(*) as total from orders) where p >= total"""
    sql["rows_rendered"] = f"""select ord, "Row", cast(p_partkey as varchar) as p_partkey, {cut_cell('p_name')} as p_name,
        {cut_cell('p_brand')} as p_brand from {numbered('*', 'part', 'p_partkey')} r
        join (values (0::bigint, 5), (1, 2), (2, 2)) as w(ord, p) on r."Row" = w.p"""
    sql["segment_lines"] = f"select * from {LINES} where line_no >= 2 and line_no < 5"
    sql["head_lines"] = f"select * from {LINES} order by file, line_no limit 7"
    sql["tail_lines"] = f"select * from {LINES} order by file desc, line_no desc limit 7"
    sql["rows_of_lines"] = f"select line_no, file, line, ord from {LINES} l join (values (0::bigint, 3), (1, 1), (2, 1)) as w(ord, p) on l.line_no = w.p"
    sql["rows_of_lines_wrapped"] = f"""select file, line_no, array_to_string({wrapped_lines('line', WIDTH)}, chr(10)) as line
        from {LINES} where line_no between 0 and 1"""
    sql["line_counts"] = f"select file, count(*) as lines from {LINES} group by file"

    sql["word_counts"] = f"""select doc_id, {en('text')} as en_words, {han('text')} as cn_chars,
        {en('text')} + {han('text')} as total from documents"""
    sql["word_counts_nopunct"] = f"""select page_id, {en('html')} as en_words, {en(bare('html'))} + {han(bare('html'))} as bare_words,
        length({bare('html')}) as bare_chars from pages"""
    sql["mixed_script"] = rf"""select doc_id, {han('t')} as cn_chars, {en('t')} + {han('t')} as total,
        length(t) + {han('t')} - len(regexp_extract_all(replace(t, chr(10), ' '), '[\x00-\x1f\x7f-\x{{9f}}]')) as width
        from (select doc_id, translate(text, 'aeiou', '一二三四五') as t from documents)"""
    sql["paragraph_counts"] = f"select doc_id, {paragraphs('text')} as paragraphs from {PARAGRAPH_DOCS}"
    sql["paragraph_table"] = f"select * from {paragraph_rows(PARAGRAPH_DOCS)}"
    sql["soft_lines"] = f"select * from {soft('documents')}"
    sql["wrapped_lines"] = f"""select file, line_no, u.i - 1 as part, u.x as line from {LINES} l,
        unnest({wrapped_lines('l.line', 40)}) with ordinality as u(x, i)"""
    pieces = lambda n: f"'  ' || array_to_string(regexp_extract_all(url, '(?s).{{1,{n}}}'), chr(10) || '  ')"
    sql["wrapped_chars"] = f"""select page_id, {pieces(16)} as wrapped,
        case when length(url) <= 16 then '  ' || url else {pieces(18)} end as first from pages"""
    sql["text_profile"] = TEXT_PROFILE
    sql["text_profile_lines"] = f"select doc_id as file, * exclude (doc_id) from ({TEXT_PROFILE})"
    sql["text_summary"] = f"""select d.doc_id, {en('text')} as en_words, {en(bare('text'))} as en_words_no_punct,
        {han('text')} as cn_chars, {han(bare('text'))} as cn_chars_no_punct, soft_lines, {paragraphs('text')} as paragraphs
        from documents d join {soft('documents')} s using (doc_id)"""

    sql["text_context"] = "select doc_id, substr(text, 1, 50000) as content, coalesce(length(text) > 50000, false) as cut from documents"
    sql["preview_context"] = """select substr(t, 1, 50000) as content, length(t) > 50000 as cut from (select 'o_orderkey' || chr(9) || 'o_custkey' || chr(9) || 'o_orderstatus' || chr(9) || 'o_orderpriority' || chr(10)
        || string_agg(o_orderkey || chr(9) || o_custkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority || chr(10), '' order by o_orderkey) as t
        from (select * from orders order by o_orderkey limit 100))"""
    joined = f"array_to_string(list_transform(string_split(regexp_replace(paragraph, '\\n$', ''), chr(10)), lambda l: {trim('l')}), ' ')"
    sql["paragraph_prompts"] = f"""select doc_id, paragraph_no, substr(p, 1, 2000) as content, length(p) > 2000 as cut,
        'system' as role0, {literal(PARAGRAPH_SYSTEM)} as system
        from (select doc_id, paragraph_no, {joined} as p from {paragraph_rows(PARAGRAPH_DOCS)})"""
    sql["overview_prompts"] = f"""select doc_id, 'user' as role1, substr(text, 1, 3000) as user, coalesce(length(text) > 3000, false) as cut,
        length({literal(OVERVIEW_SYSTEM)}) as system_chars from documents"""
    sql["conversation_history"] = f"select * from {HISTORY}"
    sql["conversation_requests"] = f"""
        select conv_id, cast(floor(turn / 64) as bigint) as part,
          string_agg(',' || cast(to_json({{'role': role, 'content': content}}) as varchar), '' order by turn) as body
        from {HISTORY} where role <> 'system' group by 1, 2
        union all select distinct conv_id, -1, {literal(REQUEST_START)} from {HISTORY}
        union all select conv_id, cast(floor(max(turn) / 64) as bigint) + 1, {literal(REQUEST_END)} from {HISTORY} group by conv_id"""
    asked = f"""(select * from {HISTORY} union all select conv_id, turn, role, content from
        (select conv_id, turn, role, {trim('text')} as content, row_number() over (partition by conv_id order by turn desc) as back from conversations)
        where back = 1 and role = 'user' and content <> '')"""
    file_text = "'[文件: f' || item_id || '.txt]' || chr(10) || '```' || chr(10) || text || chr(10) || '```'"
    file_text = f"case when item_id % 2 = 0 then {literal(prompts.FILES_PROMPT)} else chr(10) || chr(10) end || {file_text}"
    sql["pending_requests"] = f"""
        with asked as (select * from {asked})
        select conv_id, cast(floor(turn / 64) as bigint) as part,
          string_agg(',' || cast(to_json({{'role': role, 'content': content}}) as varchar), '' order by turn) as body
        from asked where role <> 'system' group by 1, 2
        union all select distinct conv_id, -1099511627777, '{{"model":"model-a","messages":[' from asked
        union all select item_id // 2, item_id % 2 - 1099511627776, case when item_id % 2 = 0 then '{{"role":"system","content":"' else '' end
          || (cast(to_json({file_text}) as varchar))[2:-2] from benchmark where item_id // 2 in (select conv_id from asked)
        union all select distinct item_id // 2, -2, '"}},' from benchmark where item_id // 2 in (select conv_id from asked)
        union all select distinct conv_id, -1, '{{"role":"system","content":"Be brief."}}' from asked
        union all select conv_id, cast(floor(max(turn) / 64) as bigint) + 1, {literal(REQUEST_END)} from asked group by conv_id"""
    sql["request_bodies"] = """select conv_id, turn, 'model-a' as model, text as user, 'system' as role0, 'false' as stream,
        0.25::double as temperature, 500::bigint as max_tokens, null::varchar as top_p, 'low' as effort, 'false' as exclude
        from conversations where role = 'user'"""
    sql["effort_levels"] = """select item_id, ['low', 'medium', 'high', 'xhigh', 'max'][item_id % 5 + 1] as effort,
        case when item_id % 5 < 3 then 'high' else 'max' end as level from benchmark"""
    block = "'[文件: f' || item_id || '.txt]' || chr(10) || '```' || chr(10) || text || chr(10) || '```'"
    sql["attach_files"] = f"""select item_id // 2 as request_id, -1 as position, item_id % 2 as part, 'system' as role,
          case when item_id % 2 = 0 then {literal(prompts.FILES_PROMPT)} else chr(10) || chr(10) end || {block} as content
        from benchmark
        union all select conv_id, turn, 0, role, text from conversations"""
    sql["parse_responses"] = """select conv_id, turn, content,
          case when ok and conv_id % 3 <> 0 then 'model-a' else 'unknown' end as model,
          case when counted then turn end as prompt_tokens, case when counted then length(text) end as completion_tokens,
          case when counted then 0::bigint end as total_tokens, not ok or content = '' as is_error
        from (select *, conv_id % 7 <> 0 as ok, conv_id % 7 <> 0 and conv_id % 5 <> 0 as counted,
          case when conv_id % 7 <> 0 and conv_id % 4 <> 0 then text else '' end as content
          from conversations where role = 'assistant')"""
    sql["parse_chunks"] = """with c as (select conv_id, turn, string_split(text, chr(10)) as l from conversations where role = 'assistant')
        select conv_id, turn, u.i * 2 as line_no, u.x as content, false as done
          from c, unnest(l) with ordinality as u(x, i) where u.x <> ''
        union all select conv_id, turn, len(l) * 2 + 2, '', true from c"""
    sql["parse_chunk_stream"] = sql["parse_chunks"]
    sql["clean_replies"] = f"""select conv_id, turn, content, content = '' as is_error from
        (select conv_id, turn, case when conv_id % 4 = 0 then '' else {trim('text')} end as content
         from conversations where role = 'assistant')"""

    sql["roundtrip_csv"] = "select * replace (cast(c_nationkey as bigint) as c_nationkey) from customer"
    sql["roundtrip_tsv"] = "select * replace (cast(p_size as bigint) as p_size) from part"
    sql["roundtrip_forced_csv"] = "select * replace (cast(s_nationkey as bigint) as s_nationkey) from supplier"
    sql["roundtrip_headerless"] = """select cast(n_nationkey as varchar) as column_0, n_name as column_1,
        cast(n_regionkey as varchar) as column_2 from nation"""
    sql["roundtrip_multiline"] = """select doc_id, '5" pipe' as size, coalesce(text, '') as text, '6"' as width from documents"""
    sql["record_fields"] = r"""select row_number() over (order by p_partkey) - 1 as record, 2 + p_partkey % 3 as fields,
        1 + len(regexp_extract_all(p_name, '\S+')) + p_partkey % 3 as words from part order by p_partkey limit 20"""
    sql["roundtrip_ragged"] = """select p_partkey, p_name || ', "q"' as name, 2 + p_partkey % 3 as n from part"""
    records = "(select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_acctbal as varchar) as c_acctbal, c_custkey as k from customer)"
    sql["records_head"] = f"select * exclude (k) from {records} order by k limit 7"
    sql["records_tail"] = f"select * exclude (k) from {records} order by k desc limit 7"
    sql["records_rows"] = f"""select "Row", c_name, c_custkey from {numbered('*', records, 'k')} where "Row" between 40 and 90"""
    sql["numbered_file_lines"] = """select o_orderstatus as status,
        row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as line_no,
        o_orderkey || ' ' || o_orderpriority as line from orders"""
    sql["fill_merged_cells"] = """select p_partkey as r, 1::bigint as c, p_name as value from part
        union all select p.p_partkey, 0, t.p_type from part p join part t on t.p_partkey = p.p_partkey // 4 * 4"""
    sql["cell_column_types"] = """select distinct c, ['boolean', 'bigint', 'double', 'string', 'percent', 'string', 'string', 'string'][c + 1] as type
        from (select event_id % 8 as c from events)"""
    sql["roundtrip_json"] = "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier"
    sql["roundtrip_parquet"] = "select * from supplier"
    sql["roundtrip_ipc"] = "select o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders"
    sql["roundtrip_xlsx"] = """select cast(p_partkey as double) as p_partkey, p_name, p_retailprice,
        cast(p_partkey % 100 as double) / 100 as share, p_size > 25 as big from part"""
    sql["roundtrip_lines"] = """select line, count(*) as n from
        (select unnest(string_split(text, chr(10))) as line from documents where text <> '') group by line"""
    sql["roundtrip_whole_text"] = f"""select sum(len(string_split(text, chr(10))))::bigint as lines,
        sum({en('text')})::bigint as en_words from benchmark"""
    sql["format_detection"] = """select page_id, ['csv', 'csv', 'json', 'json', 'json', 'ipc', 'ipc', 'parquet', 'excel', 'text'][page_id % 10 + 1]
        as format from pages"""

    stream_events = "(select event_id::varchar as event_id, value::varchar as value, event_type, props from events)"
    sql["stream_profile"] = union([string_stats(n, stream_events, True) for n in ("event_id", "value", "event_type", "props")])
    windows = """(select time_bucket(interval 1 day, ts) as w, * from events)"""
    closed = "having w + interval 1 day <= (select max(ts) from events) - interval 1 hour"
    start = "cast(epoch(w) as bigint) as window_start"
    sql["stream_window_profile"] = f"""
        select {start}, 'value' as name, 'numeric' as type, count(*) as non_empty, {sig('avg(value)')} as mean,
          min(value) as min, max(value) as max, null::bigint as en_words from {windows} group by w {closed}
        union all select {start}, 'event_type', 'string', count(*), null, null, null, sum({en('event_type')})::bigint
          from {windows} group by w {closed}"""
    sql["stream_words"] = f"""select sum(len(string_split(text, chr(10))))::bigint as lines, sum({en('text')})::bigint as en_words,
        sum({han('text')})::bigint as cn_chars, sum({en('text')} + {han('text')})::bigint as total from documents where text <> ''"""
    top = lambda c: f"(select '{c}' as name, {c}::varchar as content, count(*) as n from events group by {c} order by n desc, content limit 1)"
    sql["stream_top_values"] = union([f"select * from {top(c)}" for c in ("event_type", "props", "user_id")])
    sql["stream_first_rows"] = "select least(5, count(*)) as rows from events"
    return sql
