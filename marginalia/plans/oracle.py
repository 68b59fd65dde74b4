"""DuckDB SQL over the given tables for every query of `queries.py`.

Written as plain windows, as-of joins and recursion, apart from the Spark plans they check.
"""

import re

# Character classes as in functions/text.py.
STRIP = r"\x{AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
SPACE = r"\t\n\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Letters with another upper case of one letter, by Unicode, but none between ASCII letters and others.
CAPITALS = {c: u for c in filter(str.isprintable, map(chr, range(0x1E944)))
            for u in [c.upper() if len(c.upper()) == 1 else c.title()]
            if len(u) == 1 and u != c and u.isascii() == c.isascii()}


def clean(c):
    return (f"trim(regexp_replace(regexp_replace({c}, '[{STRIP}]', '', 'g'), "
            f"'[{SPACE}]+', ' ', 'g'), ' ')")


def fold(c):
    return f"translate({c}, '{''.join(CAPITALS)}', '{''.join(CAPITALS.values())}')"


def blank(c):
    return f"coalesce(trim(regexp_replace({c}, '[{SPACE}\\x0B\\x0C\\x{{85}}]', '', 'g')) = '', true)"


def color(c):
    bare = f"lower(ltrim({c}, '#'))"
    return (f"case when length({bare}) = 3 then substr({bare}, 1, 1) || substr({bare}, 1, 1) "
            f"|| substr({bare}, 2, 1) || substr({bare}, 2, 1) || substr({bare}, 3, 1) "
            f"|| substr({bare}, 3, 1) else {bare} end")


# "1,3,5-6,8-,4-2" on 0-based pages, and "#ff0, 0000FF".
IN_RANGE = "(page_idx = 0 or page_idx = 2 or page_idx in (4, 5) or page_idx >= 7)"
IN_COLORS = f"{color('color')} in ('ffff00', '0000ff')"
LABEL = """'*(p. ' || (page_idx + 1) || ', ' || case kind
  when 'highlight' then 'highlight' when 'rect' then 'rectangle' when 'freehand' then 'freehand'
  when 'caret' then 'caret' when 'free_text' then 'free text'
  when 'note' then 'note' || case when state <> 'None' then ', ' || state else '' end
    || case when not {no_author} then ', — ' || author else '' end end || ')*'""".format(
        no_author=blank("author"))


def block(has_image, image, passage):
    """Markdown of one annotation."""
    return f"""case kind
  when 'highlight' then coalesce('> ' || {passage} || chr(10), '')
    || case when {blank('contents')} then '' else '>' || chr(10) || '> **Comment:** ' || contents || chr(10) end
    || '>' || chr(10) || '> ' || {LABEL} || chr(10) || chr(10)
  when 'note' then '> **Note:** ' || coalesce(case when {blank('contents')} then note_text else contents end, '')
    || chr(10) || '>' || chr(10) || '> ' || {LABEL} || chr(10) || chr(10)
  when 'rect' then case when {has_image} then '![Rectangle annotation, p. ' || (page_idx + 1) || '](' || {image}
    || ')' || chr(10) || chr(10) else '' end || '>' || chr(10) || '> ' || {LABEL} || chr(10) || chr(10)
  when 'freehand' then case when not {has_image}
      then '> *[Freehand drawing — use `--images` to include a screenshot]*' || chr(10) || '>' || chr(10)
      when shown then '![Freehand annotation, p. ' || (page_idx + 1) || '](' || {image} || ')' || chr(10) || chr(10)
      else '' end || '> ' || {LABEL} || chr(10) || chr(10)
  when 'caret' then case when {blank('contents')} then '' else '> **Comment:** ' || contents || chr(10)
    || '>' || chr(10) end || '> ' || {LABEL} || chr(10) || chr(10)
  when 'free_text' then case when {blank(clean('contents'))} then ''
    else '> **Free text:** ' || {clean('contents')} || chr(10) || '>' || chr(10) end
    || '> ' || {LABEL} || chr(10) || chr(10)
  else '' end"""


# Derived tables; `{{ann}}` stands for the annotation table a query works on.
TABLES = {
    "bodies": """
      select doc_id, page_idx, array_to_string(a[2 * page_idx + 1 : 2 * page_idx + 2], chr(10)) as body
      from (select doc_id, a, unnest(range((len(a) + 1) // 2))::int as page_idx
            from (select doc_id, string_split(text, chr(10)) as a from documents))""",
    "page_text": """
      select doc_id, page_idx, case when page_idx % 2 = 0 then replace(body, 'th', 't' || chr(173) || 'h')
        when page_idx % 4 = 1 then replace(body, ' ', '  ') else body end as text
      from bodies where length(body) > 0""",
    "names": "select doc_id, 'library/' || source || '/doc.' || doc_id || '.pdf' as name from documents",
    "outline_entries": """
      with numbered as (
        select doc_id, page_idx, page_idx::bigint * 10 as id, regexp_extract(body, '^[^.\\n]*') as title,
          case when page_idx = 0 or page_idx % 4 = 2 then null
            when page_idx % 4 = 0 then page_idx::bigint * 10 - 20 else page_idx::bigint * 10 - 10 end as parent_id,
          nullif(page_idx, 0) as target
        from bodies)
      select doc_id, id, parent_id, id as sibling_ord, title, target as page_idx from numbered
      union all select doc_id, id + 1, id, id + 1, 'Sub ' || title, target from numbered where doc_id % 3 = 0
      union all select doc_id, id + 9, null, id + 9, title, target from numbered
        where doc_id % 5 = 0 and parent_id is null""",
    "outline": """
      with recursive tree as (
        select doc_id, id, title, page_idx, 0 as depth, lpad(sibling_ord::varchar, 19, '0') as outline_key
        from outline_entries where parent_id is null
        union all
        select e.doc_id, e.id, e.title, e.page_idx, t.depth + 1,
          t.outline_key || '/' || lpad(e.sibling_ord::varchar, 19, '0')
        from outline_entries e join tree t on e.doc_id = t.doc_id and e.parent_id = t.id)
      select * from tree""",
    "outline_by_place": """
      with recursive placed as (
        select *, lpad((row_number() over (partition by doc_id, parent_id order by sibling_ord) - 1)::varchar, 19, '0') as place
        from outline_entries),
      tree as (
        select doc_id, id, title, page_idx, 0 as depth, place as outline_key from placed where parent_id is null
        union all
        select e.doc_id, e.id, e.title, e.page_idx, t.depth + 1, t.outline_key || '/' || e.place
        from placed e join tree t on e.doc_id = t.doc_id and e.parent_id = t.id)
      select * from tree""",
    "headings": """
      select doc_id, title, page_idx, arg_min(depth, outline_key) as depth,
        min(outline_key) as outline_key, max(outline_key) as last_key
      from outline group by doc_id, title, page_idx""",
    "page_heads": """
      select doc_id, page_idx, title, depth, outline_key from headings where page_idx is not null
      qualify row_number() over (partition by doc_id, page_idx order by last_key desc) = 1""",
    "doc_pages": "select doc_id, max(page_idx) + 1 as n_pages from bodies group by doc_id",
    "numbered_documents": "select doc_id, row_number() over (order by doc_id) - 1 as place from documents",
    "placed_events": """
      select e.*, d.doc_id from (
        select *, case when event_id % 4 = 0 then user_id % n
          else ((event_id // 4 * 3 + event_id % 4 - 1) * 7919) % n end as place
        from events, (select greatest(count(*), 1) as n from documents)) e
      join numbered_documents d using (place)""",
    "events_as_annotations": """
      select event_id, doc_id, (case when event_id % 20 = 7 then n_pages + event_id % 3
          else (event_id * 31 + event_id // 1000) % n_pages end)::int as page_idx,
        case event_type when 'click' then case event_id % 13 when 0 then 'underline' when 1 then 'strikeout'
            when 2 then 'squiggly' else 'highlight' end when 'view' then 'note'
          when 'purchase' then 'rect' when 'error' then 'freehand'
          else case event_id % 5 when 0 then 'stamp' when 1 then 'caret' when 2 then 'caret'
               else 'free_text' end end as raw_kind,
        case when raw_kind in ('underline', 'strikeout', 'squiggly') then 'highlight' else raw_kind end as kind,
        case event_id % 4 when 0 then '#FF0' when 1 then '#FFCC00' when 2 then '##00F'
          else 'ff0000' end as color,
        case event_id % 3 when 0 then 'com' || chr(173) || 'ment  no.' || chr(9) || event_id
          when 1 then case when event_id % 7 = 0 then ' ' || chr(9) || ' ' end end as contents,
        case when event_type = 'view' then 'note ' || event_id end as note_text,
        case event_id % 4 when 1 then 'reviewer ' || (user_id % 7) when 2 then '  ' end as author,
        case event_id % 5 when 0 then 'Accepted' when 1 then 'Rejected' else 'None' end as state,
        ((event_id * 37) % 500)::float as x,
        (case when event_type = 'click' then (event_id * 53) % 60 else (event_id * 53) % 700 end)::float as y,
        (10 + event_id % 90)::float as w, (5 + event_id % 40)::float as h
      from placed_events join doc_pages using (doc_id)""",
    "annotations": """
      select *, (row_number() over (partition by doc_id, page_idx order by event_id) - 1)::int as annot_idx,
        case when kind = 'highlight' and event_id % 11 <> 0 or kind in ('note', 'rect')
          or kind = 'freehand' and event_id % 10 <> 7 then y::double else 0 end as sort_y,
        kind = 'freehand' and event_id % 10 = 7 as no_points
      from events_as_annotations""",
    "filtered": f"""
      select * replace ((row_number() over (partition by doc_id, page_idx order by annot_idx) - 1)::int as annot_idx)
      from annotations where {IN_RANGE} and {IN_COLORS}""",
    "geometry": """
      select distinct doc_id, page_idx, case when page_idx = 7 then null when doc_id % 7 = 0 then 1200
        else 2550 end as bmp_w, case when page_idx <> 7 then 3300 end as bmp_h
      from annotations""",
    "assigned": """
      select a.*, h.title, h.depth, coalesce(h.outline_key, '~') as outline_key
      from {ann} a asof left join page_heads h on a.doc_id = h.doc_id and a.page_idx >= h.page_idx""",
    "sections": """
      select doc_id, outline_key, title, depth, count(*) filter (kind = 'highlight') as highlights,
        count(*) filter (kind = 'note') as notes, count(*) filter (kind = 'rect') as rectangles,
        count(*) filter (kind = 'freehand') as freehand,
        count(*) filter (kind not in ('highlight', 'note', 'rect', 'freehand')) as other
      from assigned group by all""",
    "totals": """
      select doc_id, count(*) as annotations, count(distinct page_idx) as pages from {ann} group by doc_id""",
    "raw_text": """
      select a.doc_id, a.page_idx, a.annot_idx, a.event_id,
        case when event_id % 50 = 0 then 'no such passage'
          else translate(substr(replace(body, ' ', '  '), (1 + (event_id * 7919) % length(body))::int,
                                (14 + event_id % 30)::int), 'aeiou', 'AEIOU') end as raw
      from {ann} a join bodies b on a.doc_id = b.doc_id and a.page_idx = b.page_idx
      where a.kind = 'highlight' and length(body) > 0""",
    "glyph_text": """
      with letters as (
        select doc_id, page_idx, unnest(range(length(text)))::int as i, unnest(string_split(text, '')) as ch
        from page_text where (doc_id, page_idx) in (
          select (doc_id, page_idx) from {ann} where kind = 'highlight')),
      areas as (
        select doc_id, page_idx, annot_idx, n, x, y + 24 * n as y, w, h
        from {ann}, (select unnest([0, 1])::float as n) r
        where kind = 'highlight' and event_id % 11 <> 0 and (n = 0 or event_id % 3 = 0)),
      pieces as (
        select b.doc_id, b.page_idx, b.annot_idx, n, string_agg(ch, '' order by i) as piece
        from areas b join letters l on b.doc_id = l.doc_id and b.page_idx = l.page_idx
          and (i % 80) * 6 + 3 between x and x + w and (i // 80) * 12 + 6 between y and y + h
        group by all)
      select doc_id, page_idx, annot_idx, string_agg(piece, ' ' order by n) as raw
      from pieces group by doc_id, page_idx, annot_idx""",
    # Cleaned page text with the source position of each of its characters.
    "position_map": f"""
      with letters as (
        select doc_id, page_idx, unnest(range(1, length(text) + 1)) as i, unnest(string_split(text, '')) as c
        from page_text where (doc_id, page_idx) in (select (doc_id, page_idx) from {{mapped}})),
      kept as (select *, regexp_full_match(c, '[{SPACE}]') as space from letters
               where not regexp_full_match(c, '[{STRIP}]')),
      runs as (select *, lag(space, 1, true) over (partition by doc_id, page_idx order by i) as after_space
               from kept)
      select doc_id, page_idx, rtrim(string_agg(case when space then ' ' else c end, '' order by i), ' ') as cleaned,
        list(i order by i) as places
      from runs where not space or not after_space group by doc_id, page_idx""",
    "passages": f"""
      with shown as (
        select r.*, p.text, nullif({clean('raw')}, '') as shown
        from {{raw}} r left join page_text p on r.doc_id = p.doc_id and r.page_idx = p.page_idx),
      located as (
        select s.*, m.places, length(m.cleaned) as clean_size, strpos({fold('s.text')}, {fold("shown")}) as found_at,
          strpos({fold('m.cleaned')}, {fold('shown')}) as clean_at
        from shown s left join position_map m on s.doc_id = m.doc_id and s.page_idx = m.page_idx),
      marked as (
        select *, case when found_at > 0 then found_at when clean_at > 0 then places[clean_at] end as first,
          case when found_at > 0 then found_at + length(shown)
            when clean_at + length(shown) - 1 = clean_size then length(text) + 1
            else places[clean_at + length(shown)] end as next
        from located)
      select doc_id, page_idx, annot_idx, case
        when first is not null then substr(text, 1, (first - 1)::int) || '**'
          || substr(text, first::int, (next - first)::int) || '**' || substr(text, next::int)
        else '**' || shown || '**' end as passage
      from marked""",
    "strokes": """
      select doc_id, page_idx, annot_idx, case when not no_points then x end as min_x,
        case when not no_points then y end as min_y, case when not no_points then x + w end as max_x,
        case when not no_points then y + h end as max_y
      from {ann} where kind = 'freehand'""",
    "clusters": """
      with recursive close as (
        select a.doc_id, a.page_idx, a.annot_idx as a, b.annot_idx as b
        from strokes a join strokes b on a.doc_id = b.doc_id and a.page_idx = b.page_idx
          and sqrt((greatest(0::float, a.min_x - b.max_x, b.min_x - a.max_x) ^ 2
                  + greatest(0::float, a.min_y - b.max_y, b.min_y - a.max_y) ^ 2)) <= 50
        where a.min_x is not null and b.min_x is not null),
      reach as (
        select doc_id, page_idx, annot_idx as a, annot_idx as b from strokes
        union
        select r.doc_id, r.page_idx, r.a, c.b from reach r join close c
          on r.doc_id = c.doc_id and r.page_idx = c.page_idx and r.b = c.a)
      select s.*, cluster_idx from strokes s join (
        select doc_id, page_idx, a as annot_idx, min(b) as cluster_idx from reach group by all)
        using (doc_id, page_idx, annot_idx)""",
    # All pairs of strokes, the shortest first; a pair is a link if no shorter ones lead from one end to the other.
    "stroke_pairs": """
      select *, row_number() over (partition by doc_id, page_idx order by gap, not same, a, b) as place
      from (select a.doc_id, a.page_idx, a.annot_idx as a, b.annot_idx as b,
          sqrt((greatest(0::float, a.min_x - b.max_x, b.min_x - a.max_x) * greatest(0::float, a.min_x - b.max_x, b.min_x - a.max_x)
            + greatest(0::float, a.min_y - b.max_y, b.min_y - a.max_y) * greatest(0::float, a.min_y - b.max_y, b.min_y - a.max_y))::double) as gap,
          a.min_x = b.min_x and a.min_y = b.min_y and a.max_x = b.max_x and a.max_y = b.max_y as same
        from strokes a join strokes b on a.doc_id = b.doc_id and a.page_idx = b.page_idx and a.annot_idx < b.annot_idx
        where a.min_x is not null and b.min_x is not null)
      where gap <= 120""",
    "shorter_ways": """
      with recursive ways as (
        select doc_id, page_idx, place, a as at from stroke_pairs
        union
        select w.doc_id, w.page_idx, w.place, case when p.a = w.at then p.b else p.a end
        from ways w join stroke_pairs p on p.doc_id = w.doc_id and p.page_idx = w.page_idx and p.place < w.place
          and (p.a = w.at or p.b = w.at))
      select * from ways""",
    "cluster_boxes": """
      select doc_id, page_idx, cluster_idx, min(min_x) as x, min(min_y) as y,
        max(max_x) - min(min_x) as w, max(max_y) - min(min_y) as h
      from clusters where min_x is not null group by doc_id, page_idx, cluster_idx""",
    "boxes": """
      with entries as (
        select doc_id, page_idx, 0 as is_cluster, annot_idx as entry_idx, x, y, w, h from {ann} where kind = 'rect'
        union all select doc_id, page_idx, 1, cluster_idx, x, y, w, h from cluster_boxes),
      scaled as (
        select doc_id, page_idx, is_cluster, entry_idx, bmp_w, bmp_h,
          greatest(0, trunc(x::double * (300e0 / 72e0))::int - 40) as l,
          greatest(0, bmp_h - trunc((y + h)::double * (300e0 / 72e0))::int - 40) as t,
          trunc(w::double * (300e0 / 72e0))::int + 80 as pw, trunc(h::double * (300e0 / 72e0))::int + 80 as ph
        from entries join geometry using (doc_id, page_idx))
      select doc_id, page_idx, is_cluster, entry_idx, l as "left", t as "top",
        l + least(pw, bmp_w - l) as "right", t + least(ph, bmp_h - t) as "bottom"
      from scaled where bmp_w is not null and least(pw, bmp_w - l) > 0 and least(ph, bmp_h - t) > 0""",
    "numbered": """
      select *, 'out/images/annotation_' || case when crop_no < 1000 then lpad(crop_no::varchar, 3, '0')
          else crop_no::varchar end || '.png' as image_path
      from (select *, row_number() over (partition by doc_id order by page_idx, is_cluster, entry_idx) as crop_no
            from boxes)""",
    "images": """
      select doc_id, page_idx, entry_idx as annot_idx, image_path from numbered where is_cluster = 0
      union all
      select c.doc_id, c.page_idx, c.annot_idx, n.image_path from clusters c join numbered n
        on c.doc_id = n.doc_id and c.page_idx = n.page_idx and c.cluster_idx = n.entry_idx and n.is_cluster = 1""",
    "pictured": """
      select a.*, {folder} || regexp_extract(image_path, '[^/]*$') as image,
        image_path is not null and row_number() over (partition by a.doc_id, outline_key, image_path
          order by a.page_idx, sort_y, a.annot_idx) = 1 as shown
      from assigned a left join images i using (doc_id, page_idx, annot_idx)""",
    "plain": "select *, null::varchar as image, false as shown from assigned",
    "blocks": f"""
      select a.doc_id, a.page_idx, a.annot_idx, a.outline_key, a.sort_y,
        {block('image is not null', 'image', 'p.passage')} as markdown
      from {{shown}} a left join passages p using (doc_id, page_idx, annot_idx)""",
    "section_pages": """
      select *, row_number() over (partition by doc_id order by outline_key, page_idx) as piece_no
      from (select distinct doc_id, page_idx, outline_key from assigned)""",
    "digests": """
      with parts as (
        select doc_id, 0 as piece_no, 0 as part, '' as outline_key, 0 as sort_y, 0 as annot_idx,
          '# Annotations: ' || coalesce(regexp_extract(name, '[^/]*$'), '') || chr(10) || chr(10) || '## Summary' || chr(10)
          || chr(10) || '**' || annotations || ' annotations** across **' || pages || ' pages**' || chr(10)
          || chr(10) || '| Section | Highlights | Notes | Rectangles | Freehand | Other |' || chr(10)
          || '|---------|-----------|-------|------------|----------|-------|' || chr(10) as markdown
        from totals left join names using (doc_id)
        union all select doc_id, 0, 1, outline_key, 0, 0, '| ' || coalesce(title, '*(Other)*') || ' | '
          || highlights || ' | ' || notes || ' | ' || rectangles || ' | ' || freehand || ' | ' || other
          || ' |' || chr(10) from sections
        union all select doc_id, 0, 2, '', 0, 0, chr(10) from totals
        union all select s.doc_id, (select min(p.piece_no) from section_pages p
            where p.doc_id = s.doc_id and p.outline_key = s.outline_key), 2, outline_key, 0, 0,
          coalesce(repeat('#', least(depth + 2, 4)) || ' ' || title, '## Other Annotations') || chr(10) || chr(10)
        from sections s
        union all select b.doc_id, piece_no, 3, '', sort_y, annot_idx, markdown
        from blocks b join section_pages p on b.doc_id = p.doc_id and b.page_idx = p.page_idx)
      select doc_id, piece_no::bigint as piece_no,
        string_agg(markdown, '' order by part, outline_key, sort_y, annot_idx) as markdown
      from parts group by doc_id, piece_no""",
    "export_blocks": f"""
      select doc_id, page_idx, annot_idx, sort_y,
        {block('false', "''", "('**' || nullif(" + clean('raw') + ", '') || '**')")} as markdown
      from (select *, false as shown from annotations)
        left join (select doc_id, page_idx, annot_idx, raw from raw_text) using (doc_id, page_idx, annot_idx)""",
    "exports": """
      with spans as (
        select doc_id, page_idx from page_text where {span} union select doc_id, page_idx from annotations where {span}),
      pieces as (select *, row_number() over (partition by doc_id order by page_idx) - 1 as piece_no from spans),
      parts as (
        select s.doc_id, s.piece_no, 0 as part, 0 as sort_y, 0 as annot_idx,
          case when piece_no > 0 then '---' || chr(10) || chr(10) else '' end
            || coalesce(text || chr(10) || chr(10), '') as markdown
        from pieces s left join page_text p on s.doc_id = p.doc_id and s.page_idx = p.page_idx
        union all select b.doc_id, piece_no, 1, sort_y, annot_idx, markdown
        from export_blocks b join pieces s on b.doc_id = s.doc_id and b.page_idx = s.page_idx)
      select doc_id, piece_no, string_agg(markdown, '' order by part, sort_y, annot_idx) as markdown
      from parts group by doc_id, piece_no""",
}

RECURSIVE = {"outline", "clusters"}


def sql(select, ann="annotations", raw="raw_text", shown="plain", span="true", folder="'images/'", mapped=None):
    """The select with every derived table it needs in front."""
    names = {"ann": ann, "raw": raw, "shown": shown, "span": span, "folder": folder, "mapped": mapped or raw}
    tables = {name: _fill(body, names) for name, body in TABLES.items()}
    needed: list[str] = []

    def visit(body):
        for table in re.findall(r"\b(?:from|join)\s+(\w+)", body):
            if table in tables and table not in needed:
                visit(tables[table])
                needed.append(table)

    visit(_fill(select, names))
    ctes = ", ".join(f"{name} as ({tables[name]})" for name in needed)
    return f"with recursive {ctes} {_fill(select, names)}" if ctes else select


def _fill(body, names):
    for key, value in names.items():
        body = body.replace("{" + key + "}", value)
    return body


KEY = "doc_id, page_idx, annot_idx"
FILE = "regexp_replace(name, '\\.[^./]*$', '')"

ORACLE_SQL = {
    "annotation_scan": sql(
        f"select {KEY}, event_id, kind, color, contents, note_text, author, state, x, y, w, h, "
        "case when kind = 'highlight' and event_id % 11 <> 0 then case when event_id % 3 = 0 then 2 else 1 end "
        "else 0 end as n_rects, "
        "case when kind = 'freehand' and not no_points then 3 else 0 end as n_points from annotations"),
    "annotation_files": sql(
        f"select {KEY}, kind, color, contents, note_text, author, state, x, y, w, h, "
        "case when kind = 'highlight' and event_id % 11 <> 0 then case when event_id % 3 = 0 then 2 else 1 end "
        "else 0 end as n_rects, "
        "case when kind = 'freehand' and not no_points then 3 else 0 end as n_points from annotations"),
    "annotation_file_errors":
        "select doc_id, page_idx::int as page_idx, annot_idx::int as annot_idx, reason from documents, "
        "(values (null, null, 'not JSON'), (null, null, 'page number'), (null, null, 'pages'), (4, 0, 'record'), "
        "(4, 1, 'kind'), (4, 2, 'field'), (5, null, 'page')) as e(page_idx, annot_idx, reason) where doc_id % 20 = 0",
    "outline_files": sql("select doc_id, title, page_idx::int as page_idx, depth, outline_key from outline_by_place"),
    "outline_preorder": sql("select *, least(depth + 2, 4) as level from outline"),
    "outline_dedup": sql("select * from headings"),
    "heading_assignment": sql(f"select {KEY}, event_id, title, depth, outline_key from assigned"),
    "reading_order": sql(
        "select doc_id, outline_key, row_number() over (partition by doc_id, outline_key "
        "order by page_idx, sort_y, annot_idx) as rank, page_idx, sort_y, annot_idx, event_id from assigned"),
    "section_summary": sql("select * from sections"),
    "document_totals": sql("select * from totals"),
    "page_range_filter": sql(f"select {KEY}, event_id, kind from annotations where {IN_RANGE}"),
    "color_normalize": sql(
        f"select event_id, color, {color('color')} as normal_color from events_as_annotations"),
    "color_filter": sql(
        "select doc_id, page_idx, (row_number() over (partition by doc_id, page_idx order by annot_idx) - 1)::int "
        f"as annot_idx, event_id, color from annotations where {IN_COLORS}"),
    "reindexed_annotations": sql(f"select {KEY}, event_id from filtered"),
    "filter_report": sql(
        "select doc_id, sum(n)::bigint as annotations, count(*) as pages from ("
        "select doc_id, page_idx, max(n) as n from ("
        "select doc_id, page_idx, count(*) as n from annotations group by all "
        "union all select doc_id, page_idx, 0 from bodies where doc_id in (select doc_id from annotations)) "
        f"where {IN_RANGE} group by doc_id, page_idx) group by doc_id"),
    "color_filter_report": sql(
        "select doc_id, count(*) as annotations, count(distinct page_idx) as pages from annotations "
        f"where {IN_RANGE} and {IN_COLORS} group by doc_id"),
    "annotated_page_text": sql(
        "select * from page_text where (doc_id, page_idx) in (select (doc_id, page_idx) from annotations)"),
    "drawable_pages": sql(
        "select distinct doc_id, page_idx from annotations where kind in ('rect', 'freehand')"),
    "clean_text": "select doc_id, " + clean(
        "replace(replace(text, 'th', 't' || chr(173) || 'h'), ' ', ' ' || chr(9))") + " as cleaned from documents",
    "highlight_in_context": sql("select * from passages"),
    "position_map": sql(
        "select doc_id, page_idx, start::int as start, shift::int as shift from (select *, start = 0 or shift <> lag(shift) over ("
        "partition by doc_id, page_idx order by start) as is_new from (select doc_id, page_idx, start, place - 1 - start as shift "
        "from (select doc_id, page_idx, unnest(range(length(cleaned))) as start, unnest(places[1 : length(cleaned)]) as place "
        "from position_map))) where is_new", mapped="page_text"),
    "highlight_text_from_glyphs": sql("select * from glyph_text"),
    "annotation_labels": sql(f"select event_id, {LABEL} as label from events_as_annotations"),
    "markup_kinds": sql("select event_id, raw_kind, kind from events_as_annotations"),
    "effective_note_text": sql(
        f"select event_id, case when {blank('contents')} then note_text else contents end as note "
        "from events_as_annotations where kind = 'note'"),
    "blank_text": sql(
        f"select event_id, {blank('contents')} as no_comment, {blank('author')} as no_author "
        "from events_as_annotations"),
    "stroke_bounds": sql("select * from strokes"),
    "stroke_clusters": sql(f"select {KEY}, cluster_idx from clusters"),
    "stroke_links": sql(
        "select doc_id, page_idx, a, b, gap from stroke_pairs p where not exists (select 1 from shorter_ways w "
        "where w.doc_id = p.doc_id and w.page_idx = p.page_idx and w.place = p.place and w.at = p.b)"),
    "cluster_bounds": sql("select * from cluster_boxes"),
    "pixel_boxes": sql("select * from boxes"),
    "crop_numbering": sql("select * from numbered"),
    "crops": sql("select * from images"),
    "annotation_images": sql(
        f"select {KEY}, kind, 'images/' || regexp_extract(image_path, '[^/]*$') as image_path "
        f"from annotations left join images using ({KEY})"),
    "image_first_occurrence": sql(
        "select doc_id, outline_key, image as image_path, page_idx, sort_y, annot_idx from pictured where shown"),
    "annotation_blocks": sql(f"select {KEY}, markdown from blocks", shown="pictured"),
    "annotation_digest": sql(f"select doc_id, name, piece_no, markdown from digests join names using (doc_id)"),
    "filtered_digest_with_images": sql(
        f"select doc_id, name, piece_no, markdown from digests join names using (doc_id)", ann="filtered", raw="glyph_text", shown="pictured",
        folder="('doc.' || a.doc_id || '-annotations-images/')"),
    "digest_files": sql(
        f"select doc_id, name, piece_no, markdown, {FILE} || '-annotations.md' as file_name "
        "from digests join names using (doc_id)"),
    "corpus_export": sql(
        f"select doc_id, name, piece_no, markdown, {FILE} || '-export.md' as file_name "
        "from exports join names using (doc_id)"),
    "page_range_export": sql(f"select doc_id, name, piece_no, markdown from exports join names using (doc_id)", span=IN_RANGE),
}
