"""The session rules as one recursive query: a row per event, the state of the participant in it.

The state is the list of open sessions (those that take photos or wait for a choice, latest last) and the session
that was finished last. It is written from the rules, not from the operator, and checks it.
"""

from __future__ import annotations

_TTL_US = 30 * 60 * 1_000_000

_ITEM = "struct(v varchar, im integer, lb integer)"
_SESSION = (f"struct(id varchar, status varchar, expected integer, items {_ITEM}[], missing integer[], images integer, "
            f"cands {_ITEM}[], last bigint)")
_STEP = ("struct(session_id varchar, status varchar, expected_count integer, found_count integer, missing_count integer, "
         "image_count integer, added varchar[], missing_labels integer[], new_codes varchar[], missing_before integer, "
         "rejected varchar, expired_id varchar)")


def _session(id_: str, status: str, expected: str, items: str, missing: str, images: str, cands: str, last: str) -> str:
    return (f"{{'id': {id_}, 'status': {status}, 'expected': {expected}, 'items': {items}, 'missing': {missing}, "
            f"'images': {images}, 'cands': {cands}, 'last': {last}}}")


def _step(s: str, *, status: str = "", added: str = "[]", new_codes: str = "[]", before: str = "0", rejected: str = "null",
          expired: str = "null") -> str:
    """What is reported of session ``s``, which may be null."""
    return (f"cast({{'session_id': {s}['id'], 'status': {status or s + chr(91) + chr(39) + 'status' + chr(39) + chr(93)}, "
            f"'expected_count': coalesce({s}['expected'], 0), 'found_count': coalesce(len({s}['items']), 0), "
            f"'missing_count': coalesce(len({s}['missing']), 0), 'image_count': coalesce({s}['images'], 0), "
            f"'added': {added}, 'missing_labels': coalesce({s}['missing'], []), 'new_codes': {new_codes}, "
            f"'missing_before': {before}, 'rejected': {rejected}, 'expired_id': {expired}}} as {_STEP})")


_SETTLED = "case when {e} > 0 and len({i}) >= {e} then 'complete' else 'active' end"

STEPS = f"""
session_events as (
  select event_id, channel, participant_id, kind, t_us, audit_ok, visible, choice,
    row_number() over (partition by channel, participant_id order by t_us, event_id) as n,
    list_transform(range(1, found + 1), lambda i: {{'v': concat('c', (first_code + i - 1) % 12), 'lb': cast(i as integer)}}) as found,
    list_transform(range(found + 1, visible + 1), lambda i: cast(i as integer)) as missing
  from photo_events),
session_walk as (
  select channel, participant_id, 0::bigint as n, cast([] as {_SESSION}[]) as open, cast(null as {_SESSION}) as cur,
    cast(null as {_STEP}) as step, null::bigint as event_id, null::bigint as t_us
  from (select distinct channel, participant_id from session_events) p
  union all
  select channel, participant_id, n, cast(case when saved is null then open1
      else list_filter(case when fresh then list_append(open1, saved)
        else list_transform(open1, lambda o: case when o['id'] = saved['id'] then saved else o end) end,
        lambda o: o['status'] in ('active', 'needs_user_selection')) end as {_SESSION}[]) as open,
    cast(coalesce(saved, cur1) as {_SESSION}) as cur, step, event_id, t_us
  from (
    select *,
      case when kind = 'photo' and not audit_ok then {_step('s', status="'failed'", rejected="'audit_failed'", expired='expired')}
        when kind = 'photo' then {_step('photo', added='list_transform(added, lambda a: a.v)',
                                        new_codes="list_transform(photo['cands'], lambda c: c.v)", before='before', expired='expired')}
        when kind = 'select' and refused is not null then {_step('s', rejected='refused')}
        when kind = 'select' then {_step('choice_made', added="case when twice then [] else [picked['v']] end")}
        when s is null or s['status'] not in ('active', 'complete') then {_step('s', rejected="'not_open'")}
        else {_step('closed')} end as step,
      case when kind = 'photo' then case when audit_ok then photo end
        when kind = 'select' then case when refused is null then choice_made end
        when s['status'] in ('active', 'complete') then closed end as saved
    from (
      select *, case when not fresh and len(new) > before then {_session(
        "s0['id']", "'needs_user_selection'", 'expected', "s0['items']", 'missing1', "s0['images'] + 1", 'new', 't_us')}
        else {_session("s0['id']", _SETTLED.format(e='expected', i='items'), 'expected', 'items', 'missing1', "s0['images'] + 1",
                       f'cast([] as {_ITEM}[])', 't_us')} end as photo,
        {_session("s['id']", _SETTLED.format(e="s['expected']", i='chosen'), "s['expected']", 'chosen', "s['missing'][2:]",
                  "s['images']", f'cast([] as {_ITEM}[])', 't_us')} as choice_made,
        {_session("s['id']", "'closed'", "s['expected']", "s['items']", "s['missing']", "s['images']", "s['cands']", 't_us')} as closed
      from (
        select *,
          case when fresh then shown when len(new) <= before then new else [] end as added,
          list_concat(s0['items'], case when fresh then shown when len(new) <= before then new else [] end) as items,
          list_concat(case when fresh or len(new) > before then s0['missing'] else s0['missing'][len(new) + 1:] end,
            case when fresh or visible > 0 then missing else [] end) as missing1,
          case when twice then s['items'] else list_append(s['items'], picked) end as chosen
        from (
          select *, greatest(s0['expected'], visible) as expected, len(s0['missing']) as before,
            list_filter(shown, lambda f, i: not list_contains(list_transform(s0['items'], lambda k: k.v), f.v)
              and list_position(list_transform(shown, lambda k: k.v), f.v) = i) as new,
            case when s is null or s['status'] <> 'needs_user_selection' then 'not_awaiting_selection'
              when picked is null then 'unknown_candidate' end as refused,
            coalesce(len(list_filter(s['items'], lambda k: k.im = picked['im'] and k.lb = picked['lb'])) > 0, false) as twice
          from (
            select *, kind = 'photo' and s is null as fresh,
              list_filter(s['cands'], lambda c: c.v = choice)[1] as picked,
              coalesce(s, {_session("concat(channel, ':', participant_id, ':', event_id)", "'active'", '0', f'cast([] as {_ITEM}[])',
                                    'cast([] as integer[])', '0', f'cast([] as {_ITEM}[])', 't_us')}) as s0,
              list_transform(found, lambda f: {{'v': f.v, 'im': coalesce(s['images'], 0), 'lb': f.lb}}) as shown
            from (
              select *, case when expired is null then open else open[:-2] end as open1,
                case when expired is not null and cur['id'] = expired then {_session(
                  "cur['id']", "'expired'", "cur['expected']", "cur['items']", "cur['missing']", "cur['images']", "cur['cands']",
                  "cur['last']")} else cur end as cur1,
                case when kind = 'close' then cur when kind = 'photo' and stale then null else newest end as s
              from (
                select *, case when stale and newest['status'] = 'active' then newest['id'] end as expired
                from (
                  select e.*, w.open, w.cur, w.open[-1] as newest,
                    e.kind = 'photo' and len(w.open) > 0 and e.t_us - w.open[-1]['last'] > {_TTL_US} as stale
                  from session_walk w join session_events e
                    on e.channel = w.channel and e.participant_id = w.participant_id and e.n = w.n + 1) z0) z1) z2) z3) z4) z5) z6) z7),
session_steps as (
  select event_id, channel, participant_id, t_us, unnest(step) from session_walk where n > 0),
told as (
  select *, case when rejected = 'audit_failed' then 'Audit failed' when rejected is not null then null
    when status = 'needs_user_selection' then concat('Found ', len(new_codes), ' new barcodes but only ', missing_before,
      ' missing. Which one(s) to add? [', array_to_string(list_transform(new_codes, lambda c: concat(chr(39), c, chr(39))), ', '), ']')
    when status = 'active' and len(missing_labels) > 0
      then concat('Found ', found_count, '/', expected_count, '. Send a photo of box(es): [', array_to_string(missing_labels, ', '), ']')
    when status = 'active' then concat('Found ', found_count, '/', expected_count, '. Send another photo.') end as message
  from session_steps)
"""

STEP_ROWS = f"""with {STEPS}
select event_id, channel, participant_id, session_id, status, expected_count, found_count, missing_count, image_count,
  array_to_string(added, ',') as added, message, rejected, expired_id from told"""

TABLE_ROWS = f"""with {STEPS},
newest as (
  select * from session_steps where rejected is null
  qualify row_number() over (partition by session_id order by t_us desc, event_id desc) = 1)
select session_id, channel, participant_id,
  case when session_id in (select expired_id from session_steps where expired_id is not null) then 'expired' else status end as status,
  expected_count, found_count, missing_count, image_count, t_us as last_activity_us from newest"""
