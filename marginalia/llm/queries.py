"""The training-data operators applied to the given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    decontamination, extraction, language, licenses, lm_scoring, openings, packing, ranking, repeats, search, simhash,
    token_counts, warc)
from marginalia.operators.blocks import block_of, number_rows
from marginalia.operators.stored import new_path, stored

# Vocabulary of op5, a file of a public tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def as_page_text(documents: DataFrame) -> DataFrame:
    """A document of the given tables as the one page of a library document."""
    return documents.withColumn("page_idx", F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_for_training(documents: DataFrame) -> DataFrame:
    """Documents whose language may be learned from; the others are held out."""
    return as_page_text(documents).where(~held_out(5, 0))


def held_out(parts: int, part: int) -> Column:
    """Whether CRC-32 of doc_id as text leaves this remainder; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


@query
def op1_simhash_near_dedup(spark, sf_dir):
    pages = simhash.near_duplicate_pages(as_page_text(read(spark, sf_dir, "documents")))
    return pages.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"),
                        F.col("class_doc_id").alias("component_id"))


@query
def op2_decontamination(spark, sf_dir):
    pages = decontamination.contaminated_pages(as_page_text(read(spark, sf_dir, "documents")),
                                               read(spark, sf_dir, "benchmark"))
    return pages.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL["op2_decontamination"] = r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark where item_id is not null),
items as (select id, w, least(len(w), 13) as n from words where side = 'i' and len(w) > 0),
windows as (
  select distinct id, n, array_to_string(w[ofs + 1 : ofs + n], ' ') as passage
  from (select *, unnest(range(len(w) - n + 1)) as ofs from items)),
docs as (select id, w, len(w) as n_words from words where side = 'd'),
places as (
  select id, n, ofs, array_to_string(w[ofs + 1 : ofs + n], ' ') as passage
  from (select id, w, n, unnest(range(n_words - n + 1)) as ofs
        from docs, (select distinct n from windows) where n_words >= n)),
hits as (select p.id, p.ofs, p.n, i.id as item from places p join windows i on p.n = i.n and p.passage = i.passage),
counted as (select id, count(distinct pos) as n_hit
  from (select id, unnest(range(ofs, ofs + n)) as pos from hits) group by id),
named as (select id, count(*) as n_items, string_agg(item::varchar, ',' order by item::varchar) as items
  from (select distinct id, item from hits) group by id)
select d.id as doc_id, n_words::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n_words as contaminated
from docs d left join counted c on d.id = c.id left join named m on d.id = m.id"""


@query
def op3_language_id(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    dictionaries = language.fit_dictionaries(labelled_for_training(documents))
    return (language.page_languages(as_page_text(documents), dictionaries)
            .select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected"))


@query
def op4_warc_index(spark, sf_dir):
    """A page as a digest file; the given pages have no times, so page_id counts the seconds."""
    digests = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("file_name"), F.col("html").alias("markdown"),
        F.timestamp_seconds("page_id").alias("written_at"))
    folder = new_path(spark)
    warc.write_archives(digests, folder)
    captures = warc.merge_captures(warc.read_archives(spark, folder))
    return captures.select(F.col("doc_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op4_warc_index"] = """
with payloads as (select page_id, encode(coalesce(html, '')) as payload from pages),
bits as (
  select page_id, payload, array_to_string(list_transform(string_split(sha1(payload), ''),
    lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') as bits from payloads),
digests as (
  select page_id, octet_length(payload) as payload_bytes, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5),
      lambda j: substr(bits, 5 * i + j + 1, 1)::int << (4 - j))))::int, 1)), '') as payload_digest,
    max(page_id) over (partition by payload) as kept from bits)
select page_id, payload_bytes, payload_digest, case when page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id <> kept then kept end as refers_to from digests"""


@query
def op5_token_counts(spark, sf_dir):
    pages = as_page_text(read(spark, sf_dir, "documents"))
    return token_counts.page_tokens(pages, token_counts.read_ranks(VOCABULARY)).drop("page_idx")


@query
def op6_lm_scoring(spark, sf_dir):
    documents = as_page_text(read(spark, sf_dir, "documents"))
    pages = lm_scoring.score_pages(documents.withColumn("training", ~held_out(7, 2)))
    return pages.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_packing(spark, sf_dir):
    lengths = as_page_text(read(spark, sf_dir, "documents")).withColumn("n_tokens", packing.word_count(F.col("text")))
    return packing.pack_pages(lengths).drop("page_idx")


@query
def op8_html_extraction(spark, sf_dir):
    pages = extraction.main_text(read(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


# The given pages are of one kind; their article is what SQL can find by its tag.
ORACLE_SQL["op8_html_extraction"] = r"""
with articles as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
    '</?(?:h1|p|br)>', ' ', 'g') as body from pages),
plain as (
  select page_id, url, replace(replace(replace(replace(regexp_replace(body, '</?[a-z][^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as text from articles)
select page_id, url, trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')) as text,
  length(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')))::bigint as n_chars from plain"""


@query
def op9_license_scan(spark, sf_dir):
    return licenses.licensed_pages(as_page_text(read(spark, sf_dir, "documents")), inside=True).drop("page_idx")


TEMPLATES = ", ".join(f"({i}, '{name}', '{licenses.normal_words(text)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
ORACLE_SQL["op9_license_scan"] = rf"""
with lines as (
  select doc_id, ord, trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as words
  from (select doc_id, unnest(a) as line, unnest(range(len(a))) as ord
        from (select doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') as a from documents))),
parts as (
  select *, count_if(words = '') over (partition by doc_id order by ord) as part from lines),
passages as (
  select *, row_number() over () as id, length(words) - length(replace(words, ' ', '')) as size from (
    select doc_id, words from lines where words <> ''
    union all select doc_id, string_agg(words, ' ' order by ord) from parts where words <> ''
      group by doc_id, part having count(*) > 1
    union all select doc_id, string_agg(words, ' ' order by ord) from parts where words <> ''
      group by doc_id having count(distinct part) > 1)),
templates as (select template, license_id, words, length(words) - length(replace(words, ' ', '')) as size
  from (values {TEMPLATES}) t(template, license_id, words)),
own as (
  select id, w[i] || ' ' || w[i + 1] as bigram, count(*) as n
  from (select id, string_split(words, ' ') as w, unnest(range(1, size + 1)) as i from passages
        where size <= (select 1.5 * max(size) from templates)) group by id, bigram),
known as (
  select template, w[i] || ' ' || w[i + 1] as bigram, count(*) as n
  from (select template, string_split(words, ' ') as w, unnest(range(1, size + 1)) as i from templates) group by template, bigram),
shared as (select id, template, sum(least(o.n, k.n)) as n from own o join known k using (bigram) group by id, template),
scores as (
  select doc_id, id, license_id, 2 * n::bigint / (p.size + t.size) as dice
  from shared join passages p using (id) join templates t using (template))
select doc_id, license_id, count(distinct id) as n_places, max(dice) as best_dice
from scores where dice >= 0.8 group by doc_id, license_id"""


@query
def op10_topk_search(spark, sf_dir):
    """The queries are the documents whose doc_id is divisible by 100, whole."""
    documents = read(spark, sf_dir, "documents")
    queries = documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = search.search_pages(as_page_text(documents), queries)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


ORACLE_SQL["op10_topk_search"] = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bags as (select doc_id, word, count(*) as times from (select doc_id, unnest(w) as word from words) group by doc_id, word),
sizes as (select doc_id, len(w) as size, avg(len(w)) over () as mean, count(*) over () as n from words),
idf as (
  select word, ln(1 + ((select count(*) from words) - count(*) + 0.5) / (count(*) + 0.5)) as idf from bags group by word),
scores as (
  select q.doc_id as query_id, d.doc_id, round(sum(q.times * idf * d.times * 2.2e0
    / (d.times + 1.2e0 * (0.25e0 + 0.75e0 * size / mean))), 9) as score
  from bags q join bags d using (word) join idf using (word) join sizes s on s.doc_id = d.doc_id
  where q.doc_id % 100 = 0 group by q.doc_id, d.doc_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from scores)
select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 10"""


@query
def op11_conversation_trie(spark, sf_dir):
    """A rebuilt conversation as a document whose annotations are its turns."""
    turns = read(spark, sf_dir, "conversations").where("conv_id is not null")
    block = F.coalesce(block_of(F.col("turn"), 1024), F.lit(-(1 << 63)))
    turns = stored(number_rows(turns.withColumn("block", block), ["conv_id"], [["block"]], ["turn", "role", "text"], "place"))
    taken = F.crc32(F.col("conv_id").cast("string")) % 4
    convs = turns.select("conv_id").distinct()
    own = turns.where(F.col("place") > taken).select("conv_id", "place", "role", "text")
    first = turns.where("place <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "role", "text")
    base = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("taken", taken)
            .join(first, "base").where("place <= taken").select("conv_id", "place", "role", "text"))
    annotations = own.unionByName(base).select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("place").alias("annot_idx"),
                                               F.col("role").alias("kind"), F.col("text").alias("contents"))
    nodes = openings.shared_openings(annotations, convs.select(F.col("conv_id").alias("doc_id")))
    return nodes.select(F.col("doc_id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_doc_id").alias("parent_conv_id"),
                        F.col("n_docs").alias("n_convs"), "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"), "ends_sha256")


ORACLE_SQL["op11_conversation_trie"] = r"""
with original as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::bigint)),
        lambda bits, i: xor(bits >> 1, 3988292384::bigint * (bits & 1)))), 4294967295::bigint) % 4 as taken
  from (select distinct conv_id from original)),
rebuilt as (
  select c.conv_id, place, role, text from convs c join original o on o.conv_id = c.conv_id and place > taken
  union all select c.conv_id, place, role, text from convs c join original o on o.conv_id = base and place <= taken),
steps as (
  select conv_id, row_number() over (partition by conv_id order by place) as depth, text,
    sha256(length(role)::varchar || ' ' || role || text) as step from rebuilt),
members as (
  select conv_id, depth, array_to_string(list(step) over (partition by conv_id order by depth), '') as path,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from steps
  union all select conv_id, 0, '', 0 from convs),
nodes as (
  select path, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(words) as words,
    case when path <> '' then left(path, length(path) - 64) end as above from members group by path),
ends as (
  select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids
  from (select *, max(depth) over (partition by conv_id) as deepest from members) where depth = deepest group by path),
children as (select above, count(*) as n_children from nodes where above is not null group by above),
full_nodes as (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on c.above = n.path),
upwards as (
  select left(path, 64 * unnest(range(depth + 1))) as path, (n_children = 0)::bigint as leaf, (n_convs - 1) * words as saved from full_nodes),
sums as (select path, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from upwards group by path)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children,
  n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from full_nodes n left join nodes p on p.path = n.above join sums s on s.path = n.path left join ends e on e.path = n.path"""


@query
def op12_ranked_search(spark, sf_dir):
    """A benchmark item as an annotation whose contents are its text."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_idx"),
                                                    F.lit(0).alias("annot_idx"), F.col("text").alias("contents"))
    found = ranking.pages_spoken_of(as_page_text(read(spark, sf_dir, "documents")), items)
    return found.select(F.col("doc_id").alias("item_id"), "rank", F.col("found_doc_id").alias("doc_id"), "score")


ORACLE_SQL["op12_ranked_search"] = r"""
with terms as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents
  union all select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') from benchmark),
totals as (select count(*)::bigint as n, sum(len(t))::bigint as l from terms where side = 'd' and len(t) > 0),
postings as (
  select id, term, count(*) as tf, any_value(m) as m
  from (select id, unnest(t) as term, 10 + (90 * len(t)::bigint * n) // l as m from terms, totals where side = 'd' and len(t) > 0)
  group by id, term),
weights as (
  select term, floor(1000 * ln((2 * (select n from totals) + 2)::double / (2 * count(*) + 1)))::bigint as w from postings group by term),
asked as (select distinct id, term from (select id, unnest(t) as term from terms where side = 'i')),
scores as (
  select a.id as item_id, p.id as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked a join postings p using (term) join weights using (term) group by a.id, p.id),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""


@query
def op13_substring_dedup(spark, sf_dir):
    pages = repeats.without_repeats(as_page_text(read(spark, sf_dir, "documents")))
    return pages.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op13_substring_dedup"] = r"""
with texts as (
  select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select row, ofs, array_to_string(w[ofs + 1 : ofs + 35], ' ') as passage from (select *, unnest(range(len(w) - 34)) as ofs from texts)),
repeated as (select row, ofs from windows where passage in (select passage from windows group by passage having count(*) > 1)),
gone as (select distinct row, unnest(range(ofs, ofs + 35)) as place from repeated),
single as (select row, w[place + 1] as word, place from (select *, unnest(range(len(w))) as place from texts)),
kept as (
  select row, string_agg(word, ' ' order by place) as rest from single anti join gone using (row, place) group by row),
removed as (select row, count(*) as n from gone group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from texts left join removed using (row) left join kept using (row)"""
