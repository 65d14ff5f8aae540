"""The same queries in SQL, written from their definitions rather than from the Spark plans."""

from __future__ import annotations

EV = """
ev as (
  select *, (key_group * 4 // 128)::int as owner from (
    select event_id as seq, ts, cast(user_id as varchar) as key, event_type as channel,
      (('0x' || substr(md5(cast(user_id as varchar)), 1, 8))::bigint % 128)::int as key_group
    from events)
),
b as (
  select max(seq) * 2 // 5 as flip, max(seq) * 3 // 5 as rel, max(seq) // 50 as recent,
    min(ts)::date as d0, max(ts)::date as d1,
    (min(ts)::date + ((max(ts)::date - min(ts)::date) // 2)::int)::timestamp as mid
  from ev
)"""

PLANS = """
load as (select key, key_group, owner, count(*) as r from ev group by all),
gload as (
  select key_group, owner, sum(r) as r, sum(length(key) + 8) as bytes from load group by all
),
plans as (
  select (owner + 1)::bigint as plan_id, key_group, owner as source,
    ((owner + 1) % 4)::int as target, bytes::bigint as est_bytes
  from gload qualify row_number() over (partition by owner order by r desc, key_group) = 1
)"""


def _snapshot(name: str, cut: str) -> str:
    return f"""
{name} as (
  select 'count' as state_name, key_group, key, count(*) as n
  from ev, b where seq <= {cut} group by all
  union all
  select 'recent', key_group, key, count(*)
  from ev, b where seq <= {cut} and seq > {cut} - recent group by all
)"""


STATES = ",".join([_snapshot("s_flip", "flip"), _snapshot("s_rel", "rel")])

TRANSFER = f"""
{STATES},
own as (select (key_group * 4 // 128)::int as owner, * from s_flip),
copy as (
  select target as owner, s.* from s_flip s join plans using (key_group)
),
tgt as (select * from own union all select * from copy),
moved as (
  select target as owner, s.* from s_rel s join plans using (key_group)
),
ingested as (
  select coalesce(t.owner, m.owner) as owner, coalesce(t.state_name, m.state_name) as state_name,
    coalesce(t.key_group, m.key_group) as key_group, coalesce(t.key, m.key) as key,
    coalesce(m.n, t.n) as n
  from tgt t full join moved m
    on t.owner = m.owner and t.state_name = m.state_name and t.key_group = m.key_group
    and t.key = m.key
)"""

BARRIERS = """
pick as (
  select day, owner, key_group from (
    select ts::date as day, owner, key_group, count(*) as r from ev group by all)
  qualify row_number() over (partition by day, owner order by r desc, key_group) = 1
),
days as (
  select ts::date as day, max(seq) as at_seq, arg_max(channel, seq) as channel from ev group by 1
),
barriers as (
  select (day - d0 + 1)::bigint as migration_id, day = d1 as is_final,
    (day + 1)::timestamp as at_ts, at_seq, 'Source: ' || channel as name_part, day
  from days, b
),
items as (
  select migration_id, is_final, at_ts, at_seq,
    (row_number() over (partition by migration_id order by owner) - 1)::int as pos,
    key_group, owner as source, ((owner + 1) % 4)::int as target
  from barriers join pick using (day)
),
moves as (select key_group, at_seq, pos, target from items where not is_final),
log as (
  select * from moves
  union all
  select key_group, at_seq, -1, null from (select distinct key_group from moves),
    (select at_seq from barriers where migration_id % 7 = 0 and not is_final)
)"""

ROUTED = f"""
{BARRIERS},
last_log as (
  select key_group, at_seq, arg_max(coalesce(target, -1), pos) as target from log group by all
),
routed as (
  select ev.seq, ev.key, ev.key_group,
    case when coalesce(l.target, -1) = -1 then ev.owner else l.target end::int as owner
  from ev asof left join last_log l on ev.key_group = l.key_group and ev.seq > l.at_seq
)"""

RUNNING = """
counted as (
  select *, row_number() over (partition by key order by seq) as n from ev
)"""

HOLD = f"""
{PLANS},
{RUNNING},
replayed as (
  select c.seq, c.ts, c.key, c.key_group,
    case when p.key_group is null then 'other' when seq <= flip then 'pre'
      when seq <= rel then 'held' else 'live' end as phase,
    case when p.key_group is null then c.owner when seq <= flip then p.source else p.target end
      as owner,
    case when p.key_group is not null and seq > flip and seq <= rel then rel else seq end
      as effective_seq,
    n
  from counted c cross join b left join plans p on c.key_group = p.key_group
)"""

ARRIVALS = """
marks as (
  select day - d0 as migration_id, day::timestamp as at_ts
  from b, unnest(generate_series(d0 + interval 1 day, d1 + interval 1 day, interval 1 day)) t(x),
    lateral (select x::date as day)
),
arrivals as (
  select migration_id, owner as task, channel, min(ts) as at_ts
  from marks m join ev on ev.ts >= m.at_ts group by all
),
expected as (
  select owner as task, count(distinct channel) as expected from ev group by 1
),
alignment as (
  select m.migration_id::bigint as migration_id, e.task, coalesce(a.received, 0) as received,
    e.expected, coalesce(a.received, 0) >= e.expected as aligned,
    case when a.received >= e.expected then a.last_ts end as aligned_at
  from marks m cross join expected e left join (
    select migration_id, task, count(*) as received, max(at_ts) as last_ts
    from arrivals group by all) a on a.migration_id = m.migration_id and a.task = e.task
)"""

ROUNDS = """
schedule as (
  select schedule, round,
    case when schedule = 0 then 172800000 - (172800000 // (1 << (round - 2)))
      else 86400000 * (round - 2) end as from_ms,
    case when schedule = 0 then 172800000 - (172800000 // (1 << (round - 1)))
      else 86400000 * (round - 1) end as to_ms
  from (select unnest([0, 1]) as schedule), (select unnest(range(2, 13))::int as round)
),
spans as (
  select schedule, round, mid + from_ms * interval 1 millisecond as from_ts,
    mid + to_ms * interval 1 millisecond as to_ts
  from schedule, b
),
changed as (
  select key_group, 1 as round, key from ev, b where ts < mid
  union
  select key_group, round, key from ev join spans
    on key_group % 2 = schedule and ts >= from_ts and ts < to_ts
),
rounds as (
  select g.key_group::bigint as migration_id, r.round::int as round,
    count(c.key) as delta_size, coalesce(sum(length(c.key) + 8), 0)::bigint as bytes,
    count(c.key) < 1 as converged
  from (select distinct key_group from ev) g
  cross join (select unnest(range(1, 13)) as round) r
  left join changed c on c.key_group = g.key_group and c.round = r.round
  group by all
),
reports as (
  select *, row_number() over w as i, lag(delta_size) over w as previous
  from rounds where round >= 2 window w as (partition by migration_id order by round)
),
islands as (
  select *, coalesce(delta_size >= previous, false) as stuck,
    sum(case when coalesce(delta_size >= previous, false) then 0 else 1 end)
      over (partition by migration_id order by round) as island
  from reports
),
streaks as (
  select *, sum(stuck::int) over (partition by migration_id, island order by round) as streak
  from islands
),
decided as (
  select migration_id, round, case when converged then 'AWAIT_BARRIER'
    when streak >= 3 then 'DIVERGED' when i >= 10 then 'MAX_ROUNDS' end as outcome
  from streaks
),
outcome as (
  select m.migration_id, coalesce(d.outcome, 'PRE_COPY') as outcome,
    coalesce(d.round, m.last)::int as round
  from (select migration_id, max(round) as last from rounds group by 1) m
  left join (
    select migration_id, min_by(outcome, round) as outcome, min(round) as round
    from decided where outcome is not null group by 1) d using (migration_id)
)"""

FOLD = f"""
{ROUNDS},
base as (
  select migration_id as m, outcome, round as lastr,
    case when migration_id % 31 = 7 then 60 else 10 end as slow,
    case when migration_id % 29 = 12 then 60 else 10 end as prep
  from outcome
),
raw as (
  select m, round + 2 as pos, prep + 10 + (round - 1) * slow as at_s,
    'PreCopyRoundComplete' as kind, delta_size, bytes, converged, null::boolean as ok,
    null::varchar as reason
  from base join rounds on migration_id = m
  where round >= 2 and (round <= lastr or (m % 13 = 5 and round = lastr + 1))
  union all
  select m, 0, 0, 'StartPreCopy', null, null, null, null, null from base where m % 11 = 3
  union all
  select m, 1, 0, 'PrepareMigrationSource', null, null, null, true, null
  from base where m % 17 <> 8
  union all
  select m, 2, prep, 'PrepareMigrationTarget', null, null, null, m % 23 <> 9, null
  from base where m % 17 <> 8
  union all
  select m, 3, prep + 10, 'StartPreCopy', null, null, null, null, null from base
  union all
  select m, lastr + 4, prep + 10 + lastr * slow + 1, 'AbortMigration', null, null, null, null,
    'requested' from base where m % 19 = 4
  union all
  select m, lastr + 5, prep + 10 + lastr * slow + case when m % 7 = 6 then 120 else 10 end,
    'BarrierAligned', null, null, null, null, null from base where outcome = 'AWAIT_BARRIER'
  union all
  select m, lastr + 6, prep + 20 + lastr * slow + case when m % 7 = 6 then 120 else 10 end,
    'FinalDeltaComplete', m + 1, null, null, m % 5 <> 4, null
  from base where outcome = 'AWAIT_BARRIER'
),
events_in_order as (
  select raw.*, mid + at_s * interval 1 second as at_ts,
    row_number() over (partition by m order by pos) as i
  from raw, b
),
fold as (
  select m, 0::bigint as i, 'IDLE' as state, null::timestamp as start_ts,
    null::timestamp as entered, false as src, false as tgt, 0 as reported, 0 as rounds,
    0::bigint as bytes, null::bigint as last_delta, null::bigint as previous, 0 as streak,
    null::varchar as reason, null::timestamp as ended_at, null::varchar as late_in,
    null::timestamp as left_at, false as injected, 'IDLE' as before, null::varchar as kind
  from (select distinct m from raw)
  union all
  select m, i, case when after_state in ('COMMITTED', 'ABORTED', 'IDLE') then after_state
      else after_state end,
    case when before = 'IDLE' and after_state <> 'IDLE' then at_ts else start_ts end,
    case when after_state <> before then at_ts else entered end,
    src, tgt, reported, rounds, bytes, last_delta, previous, streak,
    case when after_state <> before then why else reason end,
    case when late then ended_at when after_state in ('COMMITTED', 'ABORTED') and
      after_state <> before then at_ts else ended_at end,
    late_in, left_at, injected or after_state = 'AWAIT_BARRIER', before, kind
  from (
    select *, case
      when before in ('COMMITTED', 'ABORTED') then before
      when before = 'IDLE' and kind not in ('PrepareMigrationSource', 'PrepareMigrationTarget')
        then 'IDLE'
      when kind = 'AbortMigration' then 'ABORTED'
      when kind in ('PrepareMigrationSource', 'PrepareMigrationTarget')
          and before in ('IDLE', 'INIT') then
        case when not ok then 'ABORTED' when src and tgt then 'PRE_COPY' else 'INIT' end
      when before = 'PRE_COPY' and kind = 'PreCopyRoundComplete' then
        case when converged then 'AWAIT_BARRIER' when streak >= 3 then 'ABORTED'
          when reported >= 10 then 'ABORTED' else before end
      when before = 'AWAIT_BARRIER' and kind = 'BarrierAligned' then 'FINALIZING'
      when before = 'FINALIZING' and kind = 'FinalDeltaComplete' then
        case when ok then 'COMMITTED' else 'ABORTED' end
      else before end as after_state,
      case when kind = 'AbortMigration' then ev_reason
        when kind like 'Prepare%' and not ok then 'prepare failed'
        when kind = 'PreCopyRoundComplete' and not converged then
          case when streak >= 3 then 'divergence' when reported >= 10 then 'maximum rounds' end
        when kind = 'FinalDeltaComplete' and not ok then 'final delta failed' end as why
    from (
      select m, i, before, start_ts, entered, at_ts, kind, ok, converged, ev_reason, late,
        late_in, left_at, ended_at, injected, reason,
        src or (kind = 'PrepareMigrationSource' and ok) as src,
        tgt or (kind = 'PrepareMigrationTarget' and ok) as tgt,
        reported + (counts and kind = 'PreCopyRoundComplete')::int as reported,
        rounds + (counts and kind = 'PreCopyRoundComplete')::int as rounds,
        bytes + case when counts and kind = 'PreCopyRoundComplete' then ev_bytes
          when counts and kind = 'FinalDeltaComplete' then delta_size else 0 end as bytes,
        case when counts and kind = 'PreCopyRoundComplete' then delta_size else last_delta end
          as last_delta,
        case when before = 'PRE_COPY' and kind = 'PreCopyRoundComplete' and not converged
          then delta_size else previous end as previous,
        case when before = 'PRE_COPY' and kind = 'PreCopyRoundComplete' and not converged then
          case when previous is not null and delta_size >= previous then streak + 1 else 0 end
          else streak end as streak
      from (
        select *, before in ('INIT', 'PRE_COPY', 'AWAIT_BARRIER', 'FINALIZING') as counts
        from (
          select f.m, e.i, f.start_ts, f.entered, f.src, f.tgt, f.reported, f.rounds, f.bytes,
            f.last_delta, f.previous, f.streak, f.injected, e.at_ts, e.kind, e.ok, e.converged,
            e.bytes as ev_bytes, e.delta_size, e.reason as ev_reason,
            late, case when late then 'ABORTED' else f.state end as before,
            case when late then 'timeout ' || f.state else f.reason end as reason,
            case when late then f.state else f.late_in end as late_in,
            case when late then e.at_ts else f.left_at end as left_at,
            case when late then deadline else f.ended_at end as ended_at
          from (
            select *, entered + case state when 'INIT' then interval 30 second
              when 'PRE_COPY' then interval 300 second
              when 'AWAIT_BARRIER' then interval 60 second
              when 'FINALIZING' then interval 60 second end as deadline
            from fold) f
          join events_in_order e on e.m = f.m and e.i = f.i + 1,
          lateral (select coalesce(e.at_ts > f.deadline, false) as late)
        )
      )
    )
  )
),
last_fold as (
  select f.*, log_end, entered + case state when 'INIT' then interval 30 second
      when 'PRE_COPY' then interval 300 second when 'AWAIT_BARRIER' then interval 60 second
      when 'FINALIZING' then interval 60 second end as deadline
  from fold f, (select max(at_ts) as log_end from events_in_order)
  qualify row_number() over (partition by m order by i desc) = 1
),
done as (
  select m as migration_id,
    case when over then 'ABORTED' else state end as state,
    case when over then 'timeout ' || state else reason end as reason,
    case when over then deadline else ended_at end as ended_at,
    case when over then state else late_in end as late_in,
    case when over then log_end else left_at end as left_at,
    start_ts, log_end, rounds, bytes, last_delta, injected
  from (select *, coalesce(log_end > deadline, false) as over from last_fold)
  where state <> 'IDLE'
)"""


def _q(*parts: str, select: str, recursive: bool = False) -> str:
    word = "with recursive" if recursive else "with"
    return f"{word} {','.join(parts)}\n{select}"


FEED_ROUNDS = """
days as (
  select key, key_group, least(greatest(datediff('day', mid::date, ts::date) + 2, 1), 6) as round from ev, b
),
feed as (
  select g.key_group::bigint as migration_id, g.round::int as round, count(d.key) as delta_size,
    cast(coalesce(sum(length(d.key) + 8), 0) as bigint) as bytes, count(d.key) < 1 as converged
  from (select distinct key_group, r.round from days, range(1, 6) r(round)) g
  left join (select distinct key, key_group, round from days) d
    on d.key_group = g.key_group and d.round = g.round
  group by 1, 2
)"""

MACHINE = """
site(state, event, next) as (values
  ('new', 'signup', 'active'), ('new', 'view', 'new'),
  ('active', 'click', 'engaged'), ('active', 'view', 'active'), ('active', 'error', 'trouble'),
  ('engaged', 'purchase', 'customer'), ('engaged', 'view', 'active'), ('engaged', 'error', 'trouble'),
  ('customer', 'purchase', 'customer'), ('customer', 'view', 'active'), ('customer', 'error', 'trouble'),
  ('trouble', 'click', 'active'), ('trouble', 'error', 'closed'), ('closed', 'signup', 'active')),
numbered as (select key, channel, seq, row_number() over (partition by key order by seq) as i from ev),
walk as (
  select distinct key, 0::bigint as i, 'new' as state, 0::bigint as refused, null::bigint as changed_seq
  from ev
  union all
  select w.key, n.i, coalesce(m.next, w.state), w.refused + (m.next is null)::bigint,
    case when m.next <> w.state then n.seq else w.changed_seq end
  from walk w join numbered n on n.key = w.key and n.i = w.i + 1
  left join site m on m.state = w.state and m.event = n.channel
),
folded as (
  select key, state, i as events, refused, changed_seq from walk
  qualify row_number() over (partition by key order by i desc) = 1
)"""

WORDS = """w as (
  select doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) as w from documents
)"""

_WORD_COUNT = _q(WORDS, select="select w, count(*) as n from w where w <> '' group by 1")
_RUNNING = _q(EV, RUNNING, select="select seq, key, n from counted")
_ALIGNMENT = _q(EV, ARRIVALS, select="select * from alignment")
_ROUTE = _q(EV, ROUTED, select="""
select key_group, owner, count(*) as records, min(seq) as min_seq, max(seq) as max_seq
from routed group by 1, 2""")
_HOLD = _q(
    EV, HOLD, select="select seq, key, key_group, phase, owner, effective_seq, n from replayed"
)
_CANCEL = _q(EV, PLANS, RUNNING, select="""
select c.seq, c.key, c.key_group,
  case when p.key_group is null or (gone and seq > half) then 'other' when seq <= flip then 'pre'
    when gone or seq <= rel then 'held' else 'live' end as phase,
  case when p.key_group is null or (gone and seq > half) then c.owner
    when seq <= flip or gone then p.source else p.target end as owner,
  case when p.key_group is null or seq <= flip then seq
    when gone then greatest(seq, half) else case when seq <= rel then rel else seq end end
    as effective_seq, n
from counted c cross join (select *, (select max(seq) // 2 from ev) as half from b) b
left join (select *, source % 2 = 0 as gone from plans) p on c.key_group = p.key_group""")
_DROP = _CANCEL.replace("source % 2 = 0 as gone", "source = 1 or target = 1 as gone")
_FOLD = _q(
    EV, FOLD, recursive=True, select="select migration_id, state, reason, ended_at from done"
)

ORACLES = {
    "tokens": _q(WORDS, select="select doc_id, w, count(*) as n from w where w <> '' group by 1, 2"),
    "word_count": _WORD_COUNT,
    "stream_word_count": _WORD_COUNT,
    "running_count": _RUNNING,
    "stream_running_count": _RUNNING,
    "stream_running_fold": """
with e as (
  select event_id as seq, cast(user_id as varchar) as key, cast(round(value * 100) as bigint) as cents
  from events
)
select seq, key, count(*) over w as n, cast(coalesce(sum(cents) over w, 0) as bigint) as cents,
  max(cents) over w as most
from e window w as (partition by key order by seq)""",
    "last_count_by_owner": _q(EV, ROUTED, RUNNING, select="""
select r.owner, r.key, max(c.n) as n, max(seq) as last_seq
from routed r join counted c using (seq) group by 1, 2"""),
    "seen_by_owner": _q(EV, ROUTED, select="""
select owner, key, count(*) as cnt, min(seq) as min_seq, max(seq) as max_seq,
  sum(seq)::bigint as sum_seq
from routed group by 1, 2"""),
    "hot_key_totals": _q(EV, select="""
select (select count(*) from ev) as records, key as hot_key, n as hot_records
from (select key, count(*) as n from ev group by 1) order by n desc, key limit 1"""),
    "key_group_assign": _q(EV, select="select distinct key, key_group, owner from ev"),
    "owner_ranges": _q(EV, select="""
select r.owner, first_group, last_group, count(distinct key) as keys, count(key) as records
from (select (g * 4 // 128)::int as owner, min(g)::int as first_group, max(g)::int as last_group
  from range(128) t(g) group by 1) r left join ev on ev.owner = r.owner group by 1, 2, 3"""),
    "owner_load": _q(EV, select="""
select owner, count(distinct key_group) as groups, count(distinct key) as keys,
  count(*) as records
from ev group by 1"""),
    "singleton_groups": _q(EV, select="""
select key_group, owner, min(key) as key from ev group by 1, 2 having count(distinct key) = 1"""),
    "partition_size": _q(EV, select="""
select key_group, count(*) as entries, sum(length(key) + 8)::bigint as est_bytes
from (select distinct key_group, key from ev) group by 1"""),
    "make_plans": _q(EV, PLANS, select="select * from plans"),
    "serve_check": _q(EV, PLANS, ROUTED, select="""
select r.owner, count(*) filter (r.key_group * 4 // 128 = r.owner) as in_range,
  count(*) filter (r.key_group * 4 // 128 <> r.owner and p.key_group is not null) as hosted,
  count(*) filter (r.key_group * 4 // 128 <> r.owner and p.key_group is null) as rejected
from routed r left join plans p on p.target = r.owner and p.key_group = r.key_group
group by 1"""),
    "physical_route": _q(EV, ROUTED, select="""
select owner, count(distinct (('0x' || substr(md5(key), 1, 8))::bigint + seq // 65536) % 8)
    as partitions, count(*) as records
from routed group by 1"""),
    "phase_stream": _q(EV, select="""
select case when seq <= flip then 1 when seq <= rel then 2 else 3 end::int as phase,
  count(*) as records
from ev, b group by 1"""),
    "state_snapshot": _q(EV, STATES, select="select * from s_flip"),
    "state_from_checkpoint": _q(EV, STATES, select="""
select key_group, key, n from s_flip where state_name = 'count'"""),
    "state_lookup": _q(EV, PLANS, STATES, select="""
select key, n from s_rel where state_name = 'count' and key in (
  select key from load qualify row_number() over (partition by owner order by r desc, key) = 1)"""),
    "extract_group": _q(EV, PLANS, STATES, select="""
select s_flip.* from s_flip semi join plans using (key_group)"""),
    "export_group": _q(EV, PLANS, STATES, select="""
select key_group, count(*) as entries, sum(n)::bigint as sum_n
from s_flip semi join plans using (key_group) group by 1"""),
    "bulk_load_group": _q(EV, PLANS, STATES, select="""
select key_group, count(*) as entries, sum(n)::bigint as sum_n from (
  select * from s_flip anti join plans using (key_group)
  union all select * from s_rel semi join plans using (key_group)) group by 1"""),
    "ingest_group": _q(EV, PLANS, TRANSFER, select="select * from ingested"),
    "replace_group": _q(EV, PLANS, TRANSFER, select="""
select * from own union all select * from moved"""),
    "state_delta": _q(EV, STATES, select="""
select coalesce(o.state_name, r.state_name) as state_name,
  coalesce(o.key_group, r.key_group) as key_group, coalesce(o.key, r.key) as key,
  case when o.key is null then 'put_new' when r.key is null then 'delete' else 'put_changed' end
    as change,
  o.n as old_n, r.n as new_n
from s_flip o full join s_rel r
  on o.state_name = r.state_name and o.key_group = r.key_group and o.key = r.key
where o.n is distinct from r.n"""),
    "apply_delta": _q(EV, STATES, select="""
select count(*) as changed_first, 0::bigint as changed_second, true as equal_after
from s_flip o full join s_rel r
  on o.state_name = r.state_name and o.key_group = r.key_group and o.key = r.key
where o.n is distinct from r.n"""),
    "delete_group": _q(EV, PLANS, STATES, select="""
select (s.key_group * 4 // 128)::int as owner,
  count(*) filter (p.key_group is not null) as deleted,
  count(*) filter (p.key_group is null) as remaining
from s_rel s left join plans p using (key_group) group by 1"""),
    "state_equal": _q(EV, PLANS, TRANSFER, """
hosted as (
  select * from ingested semi join (select target as owner, key_group from plans) p
    using (owner, key_group))""", select="""
select (select count(*) from moved) as left_rows, (select count(*) from hosted) as right_rows,
  (select count(*) from (select owner, state_name, key_group, key, n from moved
    except all select owner, state_name, key_group, key, n from hosted)) as left_only,
  (select count(*) from (select owner, state_name, key_group, key, n from hosted
    except all select owner, state_name, key_group, key, n from moved)) as right_only"""),
    "same_as_no_migration": _q(EV, select="""
select count(*) as left_rows, count(*) as right_rows, 0::bigint as left_only,
  0::bigint as right_only
from ev"""),
    "isolation_check": _q(EV, PLANS, TRANSFER, select="""
select (select count(*) from own) as kept, 0::bigint as changed,
  (select count(*) from moved) as new_moved, 0::bigint as new_other"""),
    "transfer_summary": _q(EV, PLANS, STATES, select="""
select key_group, count(*) as entries, sum(length(key) + 8)::bigint as bytes
from s_rel semi join plans using (key_group) group by 1"""),
    "abort_rollback": _q(EV, PLANS, STATES, select="""
select count(*) as source_entries, 0::bigint as target_entries, 0::bigint as overrides_left,
  true as equals_no_migration
from s_flip semi join plans using (key_group)"""),
    "precopy_rounds": _q(EV, ROUNDS, select="select * from rounds"),
    "precopy_outcome": _q(EV, ROUNDS, select="select * from outcome"),
    "state_change_feed": _q(EV, RUNNING, select="""
select case when seq <= flip then 0 when seq <= rel then 1 else 2 end::bigint as batch_id,
  key, max(n) as n
from counted, b group by 1, 2"""),
    "route_current": _q(EV, BARRIERS, select="""
select g::int as key_group, (g * 4 // 128)::int as default_owner, l.target::int as target,
  coalesce(l.target, g * 4 // 128)::int as owner
from range(128) t(g) left join (
  select key_group, target from log
  qualify row_number() over (partition by key_group order by at_seq desc, pos desc) = 1) l
  on l.key_group = g"""),
    "overrides_from_barriers": _q(EV, BARRIERS, select="""
select key_group, target, migration_id from items where not is_final
qualify row_number() over (partition by key_group order by at_ts desc, pos desc) = 1"""),
    "route_effective": _ROUTE,
    "stream_route_effective": _ROUTE,
    "affected_records": _q(EV, BARRIERS, select="""
select key_group, count(*) as records from ev
where key_group in (select key_group from items) group by 1"""),
    "unaffected_records": _q(EV, BARRIERS, select="""
select key_group, count(*) as records from ev
where key_group not in (select key_group from items) group by 1"""),
    "plan_for_partition": _q(EV, BARRIERS, select="""
select migration_id, key_group, source, target from items"""),
    "barrier_fanout": _q(EV, BARRIERS, """
tasks as (
  select 'Source: ' || channel || ' (' || i || '/4)#0' as task
  from (select distinct channel from ev), range(1, 5) t(i)
  union all select 'count (' || (owner + 1) || '/4)#0' from (select distinct owner from ev))""",
        select="""
select migration_id, count(task) as injected
from barriers left join tasks on contains(task, name_part) group by 1"""),
    "barrier_arrivals": _q(EV, ARRIVALS, select="""
select migration_id::bigint as migration_id, task, count(distinct channel) as channels_seen
from arrivals group by 1, 2"""),
    "barrier_alignment": _ALIGNMENT,
    "stream_alignment": _ALIGNMENT,
    "migration_ready": _q(EV, ARRIVALS, select="""
select migration_id, count(*) filter (aligned) as tasks_aligned,
  count(*) filter (aligned) = 4 as ready
from alignment group by 1"""),
    "hold_replay": _HOLD,
    "stream_hold_replay": _HOLD,
    "hold_cancel": _CANCEL,
    "hold_drop_owner": _DROP,
    "stream_hold_drop_owner": _DROP,
    "stream_hold_cancel": _CANCEL,
    "hold_stats": _q(EV, HOLD, select="""
select p.key_group, count(r.seq) as held,
  floor(max(epoch_us(rel_ts) - epoch_us(r.ts)) / 1000000.0)::bigint as max_wait_s,
  0::bigint as held_outside_plans
from plans p cross join (select max(ts) as rel_ts from ev, b where seq <= rel)
left join replayed r on r.key_group = p.key_group and r.phase = 'held'
group by 1"""),
    "handoff_integrity": _q(EV, HOLD, select="""
select key, count(*) as emitted, count(*) filter (phase = 'pre') as at_source,
  count(*) filter (phase <> 'pre') as at_target, 0::bigint as lost, 0::bigint as duplicated,
  true as cut_clean
from replayed where phase <> 'other' group by 1"""),
    "handoff_reconciled": _q(EV, PLANS, select="""
select key, count(*) as emitted, count(*) filter (seq <= flip) as at_source,
  count(*) filter (seq > flip) as at_target, 0::bigint as lost, 0::bigint as duplicated,
  true as cut_clean
from ev join plans using (key_group) cross join b group by 1"""),
    "state_delta_values": _q(EV, select="""
, c as (
  select event_id as seq, cast(user_id as varchar) as key, cast(round(value * 100) as bigint) as v
  from events
), o as (select key, sum(v)::bigint as cents, max(v) as most from c, b where seq <= flip group by 1),
n as (select key, sum(v)::bigint as cents, max(v) as most from c, b where seq <= rel group by 1)
select 'value' as state_name, k.key_group, n.key,
  case when o.key is null then 'put_new' else 'put_changed' end as change,
  o.cents as old_cents, o.most as old_most, n.cents as new_cents, n.most as new_most
from n left join o using (key) join (select distinct key, key_group from ev) k on k.key = n.key
where o.key is null or o.cents is distinct from n.cents or o.most is distinct from n.most"""),
    "ownership_violations": _q(EV, PLANS, select="""
select count(distinct key) as keys_checked, 0::bigint as keys_multi_owner
from ev where key_group not in (select key_group from plans)"""),
    "admit_plans": _q(EV, PLANS, BARRIERS, """
requests as (
  select (migration_id - 1) * 4 + pos as pos, key_group,
    key_group not in (select key_group from plans)
      and row_number() over (partition by key_group order by migration_id, pos) = 1 as admitted
  from items)""", select="""
select pos, key_group, admitted, case when admitted then
  sum(admitted::int) over (order by pos) end::bigint as migration_id
from requests"""),
    "admit_over_time": _q(EV, """
asked as (
  select ev.seq, key_group, ev.ts as at_ts,
    greatest(ev.ts, ev.ts + to_seconds(cast(floor(coalesce(value, 0) * 3600) as bigint))) as until_ts,
    row_number() over (partition by key_group order by ev.ts, ev.seq) as i
  from ev join (select event_id as seq, value from events) using (seq)
),
walk as (
  select seq, key_group, i, true as admitted, until_ts as free_ts from asked where i = 1
  union all
  select a.seq, a.key_group, a.i, a.at_ts >= w.free_ts,
    case when a.at_ts >= w.free_ts then a.until_ts else w.free_ts end
  from walk w join asked a on a.key_group = w.key_group and a.i = w.i + 1
)""", recursive=True, select="""
select seq as pos, key_group, admitted, case when admitted then
  sum(admitted::int) over (order by seq) end::bigint as migration_id
from walk"""),
    "apply_delta_stored": _q(EV, PLANS, STATES, """
moving as (
  select coalesce(a.key_group, z.key_group) as key_group
  from (select * from s_flip semi join plans using (key_group)) a
  full join (select * from s_rel semi join plans using (key_group)) z
    on a.state_name = z.state_name and a.key_group = z.key_group and a.key = z.key
  where a.n is distinct from z.n
)""", select="""
select count(*) as entries_first, count(distinct key_group) as folders_first,
  0::bigint as entries_second, 0::bigint as folders_second, 0::bigint as other_files_touched,
  true as equal_after
from moving"""),
    "stream_handoff_integrity": _q(EV, select="""
select key, count(*) as emitted, count(*) filter (seq % 97 = 5) as lost,
  count(*) filter (seq % 97 <> 5 and seq % 89 = 3) as repeated
from ev group by 1"""),
    "lifecycle_fold": _FOLD,
    "stream_lifecycle": _FOLD,
    "invalid_transitions": _q(EV, FOLD, """
asked as (
  select m as migration_id, before as from_state, case kind when 'StartPreCopy' then 'PRE_COPY'
    when 'BarrierAligned' then 'FINALIZING' when 'FinalDeltaComplete' then 'COMMITTED'
    when 'AbortMigration' then 'ABORTED' end as to_state
  from fold where m in (select migration_id from done))""", recursive=True, select="""
select migration_id, from_state, to_state, count(*) as events from asked
where to_state is not null and from_state <> to_state and from_state || '>' || to_state not in (
  'IDLE>INIT', 'INIT>PRE_COPY', 'INIT>ABORTED', 'PRE_COPY>AWAIT_BARRIER', 'PRE_COPY>ABORTED',
  'AWAIT_BARRIER>FINALIZING', 'AWAIT_BARRIER>ABORTED', 'FINALIZING>COMMITTED',
  'FINALIZING>ABORTED')
group by 1, 2, 3"""),
    "timeouts": _q(EV, FOLD, recursive=True, select="""
select migration_id, late_in as state,
  ((epoch_us(left_at) - epoch_us(ended_at)) // 1000000)::bigint as overdue_s
from done where late_in is not null"""),
    "migration_metrics": _q(EV, FOLD, recursive=True, select="""
select migration_id, rounds::bigint as rounds, bytes, last_delta,
  ((epoch_us(coalesce(ended_at, log_end)) - epoch_us(start_ts)) // 1000000)::bigint as duration_s,
  injected as barrier_injected, state = 'COMMITTED' as final_delta_sent
from done"""),
    "active_migrations": _q(EV, FOLD, recursive=True, select="""
select s as state, s in ('COMMITTED', 'ABORTED') as is_terminal,
  s not in ('IDLE', 'COMMITTED', 'ABORTED') as is_active,
  s in ('PRE_COPY', 'AWAIT_BARRIER') as background_ok, count(done.state) as migrations
from (select unnest(['IDLE', 'INIT', 'PRE_COPY', 'AWAIT_BARRIER', 'FINALIZING', 'COMMITTED',
  'ABORTED']) as s) t left join done on done.state = s group by 1"""),
    "precopy_from_changes": _q(EV, FEED_ROUNDS, select="select * from feed"),
    "precopy_changes_outcome": _q(EV, FEED_ROUNDS, select="""
select migration_id, coalesce(arg_min(case when converged then 'AWAIT_BARRIER' else 'DIVERGED' end, round)
    filter (converged or streak >= 3), 'PRE_COPY') as outcome,
  coalesce(min(round) filter (converged or streak >= 3), max(round))::int as round
from (
  select *, case when round = 1 then 0 else sum(stuck::int) over (
    partition by migration_id, run order by round) end as streak
  from (
    select *, sum((not stuck)::int) over (partition by migration_id order by round) as run
    from (
      select *, round > 2 and delta_size >= lag(delta_size) over (
        partition by migration_id order by round) as stuck
      from feed)))
where round > 1 group by 1"""),
    "state_handoff_fold": _q(EV, HOLD, select="""
select r.seq, r.key, r.key_group, phase, r.owner, effective_seq, r.n,
  cast(coalesce(sum(cents) over w, 0) as bigint) as cents, max(cents) over w as most,
  case when phase in ('held', 'live') then 2 else 1 end::int as query
from replayed r join (
  select event_id as seq, cast(round(value * 100) as bigint) as cents from events) v using (seq)
window w as (partition by r.key order by r.seq)"""),
    "state_all_variables": _q(EV, PLANS, """
half as (
  select ev.*, cents, key_group in (select key_group from plans) and ev.seq > flip as held
  from ev join (select event_id as seq, cast(round(value * 100) as bigint) as cents from events) using (seq), b
  where ev.seq <= (select max(seq) // 2 from ev)
)""", select="""
select 'counts' as state_name, key_group, key, '{"n":' || count(*) || ',"cents":' || coalesce(sum(cents), 0)
  || case when max(cents) is null then '' else ',"most":' || max(cents) end || '}' as value
from half where not held group by key_group, key
union all
select 'held', key_group, key, '{"seq":' || seq || ',"key":"' || key || '","owner":' || owner
  || case when cents is null then '' else ',"cents":' || cents end || '}'
from half where held
union all
select 'move', key_group, null, source || ':' || target || ':' || flip from plans, b"""),
    "machine_fold": _q(EV, MACHINE, recursive=True, select="select * from folded"),
    "machine_occupancy": _q(EV, MACHINE, recursive=True, select="""
select s as state, count(key) as entities, cast(coalesce(sum(events), 0) as bigint) as events,
  cast(coalesce(sum(refused), 0) as bigint) as refused
from (select unnest(['new', 'active', 'engaged', 'customer', 'trouble', 'closed']) as s) t
left join folded on state = s group by 1"""),
    "state_handoff": _q(EV, PLANS, RUNNING, select="""
select seq, key, n, case when seq > flip and key_group in (select key_group from plans)
  then 2 else 1 end::int as query
from counted, b"""),
    "restart_recovery": _q(EV, FOLD, PLANS, recursive=True, select="""
select key, coalesce(p.target, ev.owner) as owner, count(*) as n
from ev left join (
  select key_group, target from plans
  where key_group in (select migration_id from done where state = 'COMMITTED')
) p on p.key_group = ev.key_group
group by 1, 2"""),
    "shared_target": _q(EV, PLANS, select="""
select plan_id, key_group, source, est_bytes,
  (select min(o) from unnest([0, 1, 2, 3]) t(o) where o not in (
    select source from plans where source < 2))::int as target
from plans where source < 2"""),
}
