"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from squall.llm import line_quality as Q

_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


CHAT = """select conv_id, turn, coalesce(role, '') as role, len(regexp_extract_all(coalesce(text, ''), '(?s)<tool_call>(.*?)</tool_call>'))::bigint n_calls, 0::bigint n_linked, 0::bigint n_invalid, null::bigint top_level,
 json_object('content', coalesce(text, ''), 'conv_id', conv_id, 'role', coalesce(role, ''), 'turn', turn)::varchar message from conversations"""

QUALITY = rf"""with x as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
 win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from x where len(w) >= 8)),
 dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
 rep as (select doc_id, count(distinct i + k) n from dup, range(8) t(k) group by doc_id),
 lines as (select doc_id, l, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) tl from (select doc_id, unnest(string_split(t, chr(10))) l from x) where regexp_matches(l, '{_WORD}')),
 sized as (select *, length(regexp_replace(tl, '[\x20\x09-\x0D]+', '', 'g')) dense, length(regexp_replace(tl, '[^#*$%&|<>{{}}\\^~=_]', '', 'g')) marks from lines),
 judged as (select *, marks * 5 > dense or (dense < 12 and not regexp_matches(tl, '{_q(Q.CLOSING)}')) or regexp_matches(tl, '{_q(Q.NAVIGATION)}') or (dense < 120 and regexp_matches(lower(tl), '{_q(Q.BOILERPLATE)}')) fails from sized),
 gone as (select doc_id, sum(case when fails then dense else 0 end) lost, count(*) - count(distinct l) dups from judged group by doc_id),
 f as (select x.doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dups, 0) n_dup_lines,
  coalesce(n, 0) n_repeat_words, coalesce(lost, 0) lost, len([i for i in range(1, len(w)) if w[i] = w[i + 1]]) stutter from x left join rep on x.doc_id = rep.doc_id left join gone on x.doc_id = gone.doc_id),
 b as (select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEATED_PERCENT} * n_words base_failed from f)
 select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
 not base_failed and (word_chars = 0 or lost / word_chars <= {Q.MOST_LOST}) and stutter <= {Q.MOST_STUTTER}e0 * n_words kept from b"""

SUBSTRINGS = rf"""with x as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
 win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from x where len(w) >= 20)),
 later as (select doc_id, i from win qualify row_number() over (partition by g order by doc_id, i) > 1),
 gone as (select doc_id, list(distinct i + k) p from later, range(20) t(k) group by doc_id),
 places as (select x.doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) word from x),
 gp as (select doc_id, unnest(p) p from gone),
 kept as (select doc_id, string_agg(word, ' ' order by p) k from places anti join gp using (doc_id, p) group by doc_id)
 select x.doc_id, len(w)::bigint n_words, coalesce(len(gone.p), 0)::bigint n_removed, sha256(coalesce(k, '')) kept_sha256 from x left join gone on x.doc_id = gone.doc_id left join kept on x.doc_id = kept.doc_id"""


def _near(width: int, columns: str) -> str:
    """Components of documents whose shingle sets of this width have a similarity of 0.85 or more."""
    return rf"""with recursive x as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') w from documents),
 sh as (select distinct doc_id, case when len(w) < {width} then array_to_string(w, ' ') else array_to_string(w[i:i + {width - 1}], ' ') end g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {width} + 2))) i from x where len(w) > 0)),
 n as (select doc_id, count(*) n from sh group by doc_id),
 links as (select a, b from (select s.doc_id a, t.doc_id b, count(*) k from sh s join sh t on s.g = t.g and s.doc_id < t.doc_id group by all) p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * k >= 85 * (na.n + nb.n - k)),
 e as (select a, b from links union select b, a from links),
 reach as (select doc_id a, doc_id b from x union select r.a, e.b from reach r join e on r.b = e.a),
 c as (select a doc_id, min(b) c from reach group by a)
 select c.doc_id, coalesce(n, 0)::bigint n_shingles, c.c component_id{columns} from c left join n using (doc_id)"""


NEAR = _near(3, ", c.doc_id = c.c kept")
JACCARD = _near(4, "")

LEAKS = rf"""with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from documents),
 b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from benchmark),
 bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + 9], ' ') g from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) i from b where len(w) > 0)),
 dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
 h as (select doc_id, i, bw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
 hit as (select doc_id, count(distinct i + k) n from h, range(10) t(k) where k < h.n group by doc_id),
 it as (select doc_id, count(distinct item_id) n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from h group by doc_id)
 select d.doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(it.n, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
 from d left join hit on d.doc_id = hit.doc_id left join it on d.doc_id = it.doc_id"""

_CRC = """tab(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from tab where k < 8),
 crc_table as (select list(v order by i) c from tab where k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, by the table c."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split_regex({text}, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295)"


TRIE = rf"""with recursive {_CRC},
 t as (select conv_id, turn, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) x from conversations where conv_id is not null),
 own as (select conv_id, list(x order by turn nulls first, x) q from t group by conv_id),
 h as (select own.*, {_crc32('conv_id::varchar')} % 6 h from own, crc_table),
 built as (select h.conv_id, coalesce(b.q, [])[1:h.h] || h.q[h.h + 1:] q from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100),
 member as (select conv_id, d, q[1:d] p, d = len(q) last from (select conv_id, q, unnest(range(0, len(q) + 1)) d from built)),
 node as (select p, d, min(conv_id) c, count(*) n, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '') ends from member group by p, d),
 kids as (select p[1:d - 1] p, count(*) k from node where d > 0 group by 1),
 known as (select node.*, coalesce(k, 0) k, case when d = 0 then 0 else (n - 1) * length(p[d].t) end saved from node left join kids using (p)),
 under as (select p[1:j] p, sum(saved) saved, count(*) filter (k = 0) leaves from (select *, unnest(range(0, d + 1)) j from known) group by 1)
 select known.c conv_id, known.d depth, up.c parent_conv_id, known.n n_convs, known.k::bigint n_children, leaves::bigint n_leaves, under.saved::bigint saved_tokens, sha256(known.ends) ends_sha256
 from known join under using (p) left join node up on known.d > 0 and up.p = known.p[1:known.d - 1]"""

PHRASES = rf"""with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) t from documents),
 w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') w from p),
 f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (values (1), (2), (3)) n(k) where len(w) >= k) group by all),
 total as (select lang, sum(len(w)) n from w group by lang),
 cand as (select lang, k, phrase, f a, string_split(phrase, ' ') v from f where k > 1 and f >= 10),
 cut as (select c.lang, c.phrase, a, x.c cut, l.f l, r.f r, floor(1000000::hugeint * a * a // (l.f::hugeint * r.f)) score from cand c, (values (1), (2)) x(c), f l, f r
  where x.c < c.k and l.lang = c.lang and r.lang = c.lang and l.phrase = array_to_string(v[1:x.c], ' ') and r.phrase = array_to_string(v[x.c + 1:], ' ')),
 scored as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 inner_ as (select lang, array_to_string(v[i:i + 1], ' ') phrase, max(a) longer from cand, (values (1), (2)) x(i) where k = 3 group by all)
 select s.lang, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank, s.phrase, a, l, r, n::bigint n, score::bigint score from scored s left join inner_ i on i.lang = s.lang and i.phrase = s.phrase join total t on t.lang = s.lang
 where longer is null or 100 * longer < 50 * a qualify rank <= 2000"""
