"""The registered queries in DuckDB's SQL, written from their definitions and not from their Spark form."""

from __future__ import annotations

from . import fixtures as fx

TRACKS = """
tracks as (
  select event_id, concat('Camera_', cast(user_id % 4 + 1 as varchar)) as camera_name, user_id as track_id, frame_idx, ts,
         cast(cx - 20 - k % 30 as double) + 0.5 as x1, cast(y2 - 60 - k as double) + 0.25 as y1,
         cast(cx + 20 + k % 30 as double) + 0.75 as x2, cast(y2 as double) as y2, 0.30 + cast(k % 70 as double) / 100 as conf
  from (select *, cast(floor(value * 100) as bigint) % 640 as cx, 200 + (event_id * 7 + k * 3) % 500 as y2
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
                     row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx from events) a) b
  where event_type <> 'error')"""

DOORS = """
doors as (
  select event_id, ts, concat('Camera_', cast(user_id % 4 + 1 as varchar)) as camera_name, concat('Door_', cast(user_id % 3 as varchar)) as door_id,
         user_id as track_id, case when event_type in ('signup', 'view') then 'ENTRY' else 'EXIT' end as event
  from events where event_type <> 'error')"""

ARRIVALS = "arrivals as (select event_id, ts, concat('Camera_', cast(user_id % 4 + 1 as varchar)) as camera_name from events)"

FEATURES = """features as (select vec_id as id, cast(label as bigint) as pid, vec_id % 6 as cid, cast(label as bigint) as label,
    cast(embedding as double[]) as e from embeddings)"""

LINES = "lines(camera_name, door_id, door_name, sx, sy, ex, ey, inside_sign, band, direction, kind) as (values " + ", ".join(repr(x) for x in fx.LINES) + ")"

_XS = [x for x, _ in fx.POLYGON]
_YS = [y for _, y in fx.POLYGON]
#: The region is a rectangle: half-open in y as ray casting counts edges, and in x as its strict comparison does.
INSIDE = f"(px >= {min(_XS)} and px < {max(_XS)} and py >= {min(_YS)} and py < {max(_YS)})"
REGION_CAMERAS = "(" + ", ".join(repr(c) for c in fx.REGION_CAMERAS) + ")"

#: Whole coordinates, stretches of presence and the foot point.
SEGMENTS = """
whole as (select *, cast(trunc(x1) as bigint) as a1, cast(trunc(y1) as bigint) as b1, cast(trunc(x2) as bigint) as a2, cast(trunc(y2) as bigint) as b2,
                 frame_idx - row_number() over (partition by camera_name, track_id order by frame_idx) as seg from tracks),
feet as (select *, cast(floor((a1 + a2) / 2.0) as bigint) as fx, b2 as fy from whole),
moves as (select *, fx - lag(fx) over s as dx, fy - lag(fy) over s as dy from feet window s as (partition by camera_name, track_id, seg order by frame_idx)),
speeds as (select *, sqrt(dx * dx + dy * dy) as moved, case when dx is null then null when dx = 0 and dy = 0 then 0.0
else dx / sqrt(dx * dx + dy * dy) end as vx,
                  case when dx is null then null when dx = 0 and dy = 0 then 0.0 else dy / sqrt(dx * dx + dy * dy) end as vy from moves)"""

POINTS = """
points as (select t.*, l.door_id, l.sx, l.sy, l.ex, l.ey, l.inside_sign, l.band, l.direction, fx as px,
                  case l.kind when 'center' then cast(floor((b1 + b2) / 2.0) as bigint) when 'top' then b1
                       when 'mid-foot' then cast(floor((cast(floor((b1 + b2) / 2.0) as bigint) + b2) / 2.0) as bigint) else b2 end as py
           from speeds t join lines l using (camera_name)),
crossed as (select *, (ex - sx) * (py - sy) - (ey - sy) * (px - sx) as c, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as len from points)"""


def _events(strict: bool = False) -> str:
    within = "and (ex - sx) * (px - sx) + (ey - sy) * (py - sy) between 0 and len * len" if strict else ""
    return f"""{POINTS},
sides as (select *, case when c <> 0 and abs(c) / len > band {within} then sign(c) end as side from crossed),
seen as (select *, last_value(side ignore nulls) over (partition by camera_name, track_id, door_id, seg
order by frame_idx rows between unbounded preceding and 1 preceding) as before from sides),
line_events as (select *, case when side = inside_sign then 'ENTRY' else 'EXIT' end as event, ((ex - sx) / len) * vx + ((ey - sy) / len) * vy as along
                from seen where side <> before)"""


_ALLOWED = """not coalesce((vx <> 0 or vy <> 0) and ((direction = 'entry' and (event = 'EXIT' or not along > 0.1)) or (direction = 'exit'
    and (event = 'ENTRY' or not along > 0.1))), false)"""
_COLUMNS = "camera_name, door_id, track_id, frame_idx, event, px, py"

REGION = f"""
region_points as (select *, fx as px, fy as py, frame_idx as f from speeds where camera_name in {REGION_CAMERAS}),
region_inside as (select *, {INSIDE} as inside from region_points),
region_before as (select *, lag(inside) over (partition by camera_name, track_id, seg order by frame_idx) as before from region_inside),
region_events as (select camera_name, 'Room_Entry' as door_id, track_id, frame_idx, case when inside then 'ENTRY' else 'EXIT' end as event, px, py
from region_before where inside <> before)"""

OCCUPANCY = f"""{DOORS},
sums as (select *, {fx.SEED_OCCUPANCY} + sum(case when event = 'ENTRY' then 1 else -1 end) over (order by ts, event_id) as s from doors),
counts as (select *, cast(s - least(0, min(s) over (order by ts, event_id)) as bigint) as occupancy from sums),
peaks as (select *, greatest({fx.SEED_OCCUPANCY}, coalesce(max(case when event = 'ENTRY' then occupancy end) over (order by ts, event_id),
0)) as peak from counts)"""

TICKS = """
frames as (select camera_name, frame_idx, row_number() over (partition by camera_name order by frame_idx) as tick from (select distinct camera_name,
frame_idx from tracks)),
ticked as (select t.*, tick, tick - row_number() over (partition by t.camera_name, track_id order by tick) as tseg from tracks t
join frames f on t.camera_name = f.camera_name and t.frame_idx = f.frame_idx),
ended as (select camera_name, track_id, tseg, max(tick) as last_tick from ticked group by all),
gone as (select * from ended where last_tick < (select max(tick) from frames f where f.camera_name = ended.camera_name))"""

_MX, _TOP, _BOTTOM = 40, 36, 86
EDGE = f"""(a1 < {_MX} or a2 > {fx.FRAME_W - _MX} or b1 < {_TOP} or b2 > {fx.FRAME_H - _BOTTOM} or greatest(1, b2 - b1) / cast(greatest(1,
    a2 - a1) as double) < 1.5)"""

OBSERVED = f"""
observed as (select w.*, (track_id * 31 + frame_idx) % (select count(*) from embeddings) as vec_id, {EDGE} as is_edge, frame_idx % 11 <> 0 as usable
from whole w),
progress as (select *, sum(case when usable then 1 else 0 end) over s as n_usable, sum(case when usable and not is_edge then 1 else 0 end) over s as n_stable
             from observed window s as (partition by camera_name, track_id, seg order by frame_idx rows unbounded preceding)),
mature as (select camera_name, track_id, frame_idx as mature_frame, n_stable, n_usable, seg
           from (select *, row_number() over (partition by camera_name, track_id order by frame_idx) as rn from progress
           where n_stable >= 3 or n_usable >= 5) where rn = 1)"""

IMAGES = """
images as (select cast(doc_id as varchar) as path, case lang when 'en' then 'night' else 'day' end as kind, case when doc_id % 3 = 0 then 'b'
else 'a' end as dataset
           from documents where lang in ('en', 'fr')),
ranked as (select *, row_number() over (partition by dataset order by md5(concat('42:', path)), path) as rn, (select count(*) from images
where kind = 'day') as day from images where kind = 'night'),
chunks as (select dataset, cast(ceil(count(*) / any_value(day)) as bigint) as n from ranked group by dataset),
starts as (select dataset, coalesce(sum(n) over (order by dataset rows between unbounded preceding and 1 preceding), 0) as first from chunks),
rotated as (select dataset, path, kind, cast(-1 as bigint) as rotation from images where kind = 'day'
            union all select dataset, path, kind, cast(floor((rn - 1) / cast(day as double)) + first as bigint) from ranked join starts using (dataset))"""

BOXES = f"""
boxes as (select concat(camera_name, '_', frame_idx) as image_id, event_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, {fx.FRAME_W}.0 as width,
{fx.FRAME_H}.0 as height from tracks),
cut as (select *, greatest(x, 0) as x0, greatest(y, 0) as y0, least(w, width - greatest(x, 0)) as w0, least(h, height - greatest(y, 0)) as h0 from boxes)"""

SIMILAR = f"""
{FEATURES},
units as (select id, pid, cid, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-8)) as u from features)"""

MATCHED = f"""
{SIMILAR},
scored as (select a.id, b.id as matched_id, round(list_inner_product(a.u, b.u), 9) as s from units a join units b on b.id < a.id),
best as (select id, matched_id, s from (select *, row_number() over (partition by id order by s desc, matched_id) as rn from scored where s >= 0.3)
where rn = 1),
linked as (select u.id, matched_id, s from units u left join best using (id)),
walk as (select id, matched_id, s, coalesce(matched_id, id) as root from linked
         union all select w.id, w.matched_id, w.s, l.matched_id from walk w join linked l on l.id = w.root where l.matched_id is not null),
named as (select id, any_value(matched_id) as matched_id, any_value(s) as s, min(root) as global_id from walk group by id)"""


def oracle_sql() -> dict[str, str]:
    t = f"with {TRACKS}"
    events = f"{t}, {LINES}, {SEGMENTS}, {_events()}"
    found = {
        "door_entries": f"""{events} select camera_name, door_id, count(*) filter (event = 'ENTRY') as entered,
            count(*) filter (event = 'EXIT') as exited from line_events where {_ALLOWED} group by all""",
        "line_crossings": f"{events} select {_COLUMNS} from line_events",
        "line_crossings_strict": f"{t}, {LINES}, {SEGMENTS}, {_events(strict=True)} select {_COLUMNS} from line_events",
        "direction_filtered_crossings": f"{events} select {_COLUMNS} from line_events where {_ALLOWED}",
        "region_crossings": f"{t}, {SEGMENTS}, {REGION} select {_COLUMNS} from region_events",
        "crossings_mode_both": f"""{events}, {REGION}, kept as (select {_COLUMNS} from line_events where {_ALLOWED})
            select * from kept union all select {_COLUMNS} from region_events r where not exists
            (select 1 from kept k where k.camera_name = r.camera_name and k.frame_idx = r.frame_idx and k.track_id = r.track_id and k.event = r.event)""",
        "region_filtered_line_events": f"{events} select {_COLUMNS} from line_events where camera_name not in {REGION_CAMERAS} or (event = 'ENTRY') = {INSIDE}",
        "filtered_tracks": f"""{t}, {SEGMENTS} select event_id, camera_name, track_id, frame_idx from (select *, fx as px, fy as py from feet)
            where camera_name not in {REGION_CAMERAS} or {INSIDE}""",
        "inside_outside_counts": f"""{t}, {SEGMENTS}, {REGION} select camera_name, frame_idx, count(*) filter (inside) as n_inside,
            count(*) filter (not inside) as n_outside from region_inside group by all""",
        "movement_direction": f"""{t}, {SEGMENTS}, d as (select *,
            vx * (400 / sqrt(400 * 400 + 320 * 320)) + vy * (320 / sqrt(400 * 400 + 320 * 320)) as dot from speeds)
            select event_id, round(vx, 6) as vx, round(vy, 6) as vy, case when moved >= 1 and dot > 0.1 then 'forward' when moved >= 1 and dot < -0.1
            then 'backward' else 'none' end as movement from d""",
        "edge_partial_flags": f"""{t}, {SEGMENTS} select event_id, {EDGE} as is_edge, least(a2, {fx.FRAME_W}) - greatest(a1, 0) >= 32 and least(b2,
            {fx.FRAME_H}) - greatest(b1, 0) >= 64 as has_crop from whole""",
        "confident_detections": f"{t} select camera_name, count(*) as n, round(avg(conf), 6) as mean_conf from tracks where conf >= 0.45 group by camera_name",
        "iou_pairs": f"""{t}, p as (select a.camera_name, a.frame_idx, a.track_id as a_id, b.track_id as b_id,
            greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
            (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as area
            from tracks a join tracks b on a.camera_name = b.camera_name and a.frame_idx = b.frame_idx and a.track_id < b.track_id)
            select camera_name, frame_idx, a_id, b_id, round(i / (area - i + 1e-8), 6) as iou from p where i / (area - i + 1e-8) >= 0.20""",
        "occupancy_timeline": f"with {OCCUPANCY} select event_id, event, occupancy, peak from peaks",
        "per_door_counts": f"""with {DOORS} select door_id, count(*) filter (event = 'ENTRY') as entered, count(*) filter (event = 'EXIT') as exited
            from doors group by door_id""",
        "session_summary": f"""with {OCCUPANCY}, top as (select max(occupancy) as top from counts where event = 'ENTRY')
            select 'Room' as room, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) as session_elapsed_s, arg_max(occupancy, ts) as final_occupancy,
            count(*) filter (event = 'ENTRY') as total_entered, count(*) filter (event = 'EXIT') as total_exited, greatest({fx.SEED_OCCUPANCY},
            (select top from top)) as peak_occupancy,
            strftime(case when (select top from top) > {fx.SEED_OCCUPANCY} then min(ts) filter (event = 'ENTRY' and occupancy = (select top
            from top)) else min(ts) end, '%Y-%m-%d %H:%M:%S.%g') as peak_time,
            count(distinct door_id) as doors from counts""",
        "event_log": f"with {OCCUPANCY} select strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as \"timestamp\", camera_name, door_id, door_id as door_name, event, track_id, occupancy as occupancy_after from peaks",
        "fps_per_second": f"""with {ARRIVALS}, c as (select camera_name, date_trunc('second', ts) as s, count(*) as n from arrivals group by all)
            select camera_name, strftime(s, '%Y-%m-%d %H:%M:%S') as second, n, round(avg(n) over (partition by camera_name
            order by s rows between 29 preceding and current row), 6) as rolling_mean from c""",
        "rolling_rates": f"""with {ARRIVALS}, d as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by camera_name order by ts, event_id) as us
            from arrivals), r as (select *, case when us > 0 then 1e6 / us end as rate from d)
            select event_id, round(rate, 6) as rate, round(avg(rate) over (partition by camera_name order by ts, event_id
            rows between 29 preceding and current row), 6) as rolling_rate from r""",
        "inside_signs": f"""{t}, {LINES}, {SEGMENTS}, p as (select f.camera_name, l.door_id, cast(sign((ex - sx) * (b2 - sy) - (ey - sy) * (fx - sx)) as bigint) as s
            from feet f join lines l using (camera_name)) select camera_name, door_id, case when s <> 0 then s end as inside_sign, count(*) as n from p group by all""",
        "latest_buffer": f"""with {ARRIVALS} select camera_name, event_id, rn from (select *, row_number() over (partition by camera_name,
            date_trunc('hour', ts) order by ts desc, event_id desc) as rn from arrivals) where rn <= 2""",
        "frame_duplication": f"""with {ARRIVALS}, g as (select event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by camera_name
            order by ts, event_id)) / 1e6 as d from arrivals)
            select event_id, case when d is null then 1 else greatest(1, least(cast(round_even(d * 0.01, 0) as bigint), 8)) end as copies from g""",
        "source_stats": f"""{t}, p as (select camera_name, frame_idx, case when frame_idx >= 5 then track_id end as person from tracks)
            select camera_name, count(distinct frame_idx) as frames, count(*) as detections, count(distinct person) as persons,
            count(distinct coalesce(person, -1)) as persons_compat,
            round(count(*) / cast(greatest(count(distinct frame_idx), 1) as double), 3) as per_frame from p group by camera_name""",
        "max_frames": f"{t} select camera_name, count(*) as n from tracks where frame_idx < 10 group by camera_name",
        "event_flash": f"""with {DOORS} select camera_name, event_id, rn from (select d.camera_name, event_id,
            row_number() over (partition by d.camera_name order by ts desc, event_id desc) as rn
            from doors d join (select camera_name, max(ts) as newest from doors group by camera_name) n on d.camera_name = n.camera_name
            and ts >= newest - interval 1 day) where rn <= 8""",
        "presence_segments": f"""{t}, {SEGMENTS} select camera_name, track_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame,
            count(*) as n_frames from whole group by camera_name, track_id, seg""",
        "departures": f"{t}, {TICKS} select camera_name, track_id, last_tick, last_tick + 1 as missing_tick from gone",
        "departure_views": f"""{t}, {TICKS}, v as (select k.camera_name, k.track_id, k.tseg, g.last_tick, k.frame_idx,
            (k.track_id * 31 + k.frame_idx) % (select count(*) from embeddings) as vec_id,
            row_number() over (partition by k.camera_name, k.track_id, k.tseg order by tick desc) as rn from ticked k
            join gone g on k.camera_name = g.camera_name and k.track_id = g.track_id and k.tseg = g.tseg where k.frame_idx % 11 <> 0),
            l as (select camera_name, track_id, last_tick, string_agg(cast(vec_id as varchar), ',' order by frame_idx) as views from v
            where rn <= 5 group by camera_name, track_id, tseg, last_tick)
            select camera_name, track_id, last_tick, views from (select *, row_number() over (partition by camera_name, track_id
            order by last_tick desc) as k from l) where k = 1""",
        "cosine_topk": f"""with {SIMILAR}, s as (select a.id as query_id, b.id as gallery_id, round(list_inner_product(a.u, b.u), 9) as s
            from units a join units b on a.id <> b.id where a.id % 100 = 0)
            select query_id, rank, gallery_id, round(s, 6) as similarity from (select *, row_number() over (partition by query_id order by s desc,
            gallery_id) as rank from s) where rank <= 5""",
        "cmc_map": f"""with {SIMILAR}, q as (select * from units where id % 5 = 0), g as (select * from units where id % 5 <> 0),
            s as (select q.id as q, g.pid = q.pid as hit, row_number() over (partition by q.id order by round(list_inner_product(q.u, g.u), 9) desc,
            g.id) as rank from q join g on not (q.pid = g.pid and q.cid = g.cid)),
            h as (select q, rank, row_number() over (partition by q order by rank) as k from s where hit),
            e as (select q, avg(k / cast(rank as double)) as ap, min(rank) as first from h group by q),
            a as (select q.id, e.ap, e.first, exists (select 1 from s where s.q = q.id) as kept from q left join e on e.q = q.id)
            select round(sum(case when kept then coalesce(ap, 0) end) / count(*) filter (kept), 6) as map,
            round(count(*) filter (first <= 1) / count(*), 6) as cmc_1,
            round(count(*) filter (first <= 5) / count(*), 6) as cmc_5, round(count(*) filter (first <= 10) / count(*), 6) as cmc_10 from a""",
        "similarity_separation": f"""with {SIMILAR}, s as (select a.pid = b.pid as same, list_inner_product(a.u, b.u) as s from units a
            join units b on a.id < b.id),
            r as (select avg(s) filter (same) as m, stddev_pop(s) filter (same) as d, avg(s) filter (not same) as n,
            stddev_pop(s) filter (not same) as e from s)
            select round(m, 6) as same_mean, round(d, 6) as same_std, round(n, 6) as different_mean, round(e, 6) as different_std, round(m - n,
            6) as separation from r""",
        "triplet_loss": f"""with {FEATURES}, p as (select a.e as a, b.e as b, c.e as c from features a join features b on b.id = a.id + 1
            join features c on c.id = a.id + 2 where a.id % 3 = 0)
            select count(*) as triplets, round(avg(greatest(0, pow(list_distance(a, b), 2) - pow(list_distance(a, c), 2) + 0.3)), 6) as loss from p""",
        "batch_hard_loss": _hard(strict=True),
        "batch_hard_loss_compat": _hard(strict=False),
        "tracklet_maturity": f"{t}, {SEGMENTS}, {OBSERVED} select camera_name, track_id, mature_frame, n_stable, n_usable from mature",
        "tracklet_mean": f"""{t}, {SEGMENTS}, {OBSERVED}, {FEATURES},
            v as (select o.camera_name, o.track_id, mature_frame, e from observed o join mature m on o.camera_name = m.camera_name
            and o.track_id = m.track_id and o.seg = m.seg join features f on f.id = o.vec_id where usable and frame_idx <= mature_frame),
            m as (select camera_name, track_id, mature_frame, count(*) as n, i, avg(e[i]) as x from v, (select unnest(range(1,
            1 + (select any_value(len(e)) from features))) as i) group by camera_name, track_id, mature_frame, i),
            l as (select *, sqrt(sum(x * x) over (partition by camera_name, track_id)) as len from m)
            select camera_name, track_id, mature_frame, cast(ceil(n / cast(greatest(1, n // 10) as double)) as bigint) as views,
            cast(i - 1 as integer) as i, round(x / (len + 1e-8), 6) as v from l""",
        "identity_match_set": f"with recursive {MATCHED} select id, matched_id, round(s, 6) as similarity, global_id from named",
        "gallery_stats": f"""with recursive {MATCHED}, c as (select global_id, count(distinct cid) as cameras from named
            join features using (id) group by global_id)
            select count(*) as total_persons, max(global_id) + 1 as next_global_id, count(*) filter (cameras > 1) as cross_camera_persons,
            (select count(distinct cid) from features) as total_cameras from c""",
        "reservoir_sample": f"""with {FEATURES}, n as (select id, pid, row_number() over (partition by pid order by id) <= 10 as anchor from features),
            k as (select *, row_number() over (partition by pid, anchor order by md5(concat('7:', pid, ':', id)), id) as k
            from n) select pid, id, anchor from k where anchor or k <= 20""",
        "yolo_normalize": f"""{t}, {BOXES} select image_id, event_id as "order", round(least(1, greatest(0, (x0 + w0 / 2) / width)), 10) as xc,
            round(least(1, greatest(0, (y0 + h0 / 2) / height)), 10) as yc,
            round(least(1, greatest(0, w0 / width)), 10) as w, round(least(1, greatest(0, h0 / height)), 10) as h from cut
            where w > 0 and h > 0 and h >= 70 and w0 > 0 and h0 > 0""",
        "yolo_normalize_unclipped": f"""{t}, {BOXES} select image_id, event_id as "order", round(least(0.999, greatest(0.001, (x + w / 2) / width)),
            10) as xc, round(least(0.999, greatest(0.001, (y + h / 2) / height)), 10) as yc,
            round(least(0.999, greatest(0.001, w / width)), 10) as w, round(least(0.999, greatest(0.001, h / height)), 10) as h from boxes""",
        "annotation_counts": f"""{t}, {BOXES}, i as (select image_id, count(*) filter (h >= 100 and w > 0 and w0 > 0 and h0 > 0) as good
            from cut group by image_id)
            select count(*) filter (image_id not like '%0' and good > 0) as converted, count(*) filter (image_id like '%0') as no_image,
            count(*) filter (image_id not like '%0' and good = 0) as no_person,
            (select count(*) from boxes) as annotations from i""",
        "rotation_plan": f"with {IMAGES} select rotation, kind, dataset, count(*) as n from rotated group by all",
        "rotation_report": f"""with {IMAGES}, d as (select count(*) as day from images where kind = 'day'), r as (select rotation, count(*) as night
            from rotated where rotation >= 0 group by rotation)
            select rotation, day, night, round(night * 100 / cast(day + night as double), 1) as night_percent from r, d""",
        "rotation_members": f"""with {IMAGES} select rotation, path, kind from rotated where rotation >= 0
            union all select r.rotation, path, kind from rotated i, (select distinct rotation from rotated where rotation >= 0) r where i.rotation = -1""",
        "training_plan": f"""with {IMAGES} select rotation, concat('rot', rotation, '/best.pt') as weights_out, case when rotation = 0
            then 0.001::double else 0.0005::double end as lr, case when rotation = 0 then 10 else 0 end as freeze,
            case when rotation = 0 then 'base.pt' else concat('rot', rotation - 1, '/best.pt') end as weights_in from (select distinct rotation
            from rotated where rotation >= 0)""",
        "sweep_remaining": """select conf, iou, imgsz from (values (0.15::double), (0.25), (0.35)) a(conf), (values (0.45::double), (0.55),
            (0.65)) b(iou), (values (640), (960)) c(imgsz)
            where (conf, iou, imgsz) not in ((0.15::double, 0.45::double, 640), (0.25::double, 0.55::double, 960), (0.35::double, 0.65::double, 640))""",
        "training_history_best": """with h as (select event_id // 100 as epoch, round(avg(value), 6) as loss from events group by 1)
            select epoch, loss, coalesce(loss < min(loss) over (order by epoch rows between unbounded preceding and 1 preceding), true) as is_best,
            min(loss) over (order by epoch rows unbounded preceding) as best, round(3e-4 * pow(0.5, epoch // 10), 12) as lr from h""",
        "stream_crossings": f"{events} select {_COLUMNS} from line_events",
        "stream_direction_crossings": f"{events} select {_COLUMNS} from line_events where {_ALLOWED}",
        "stream_region_crossings": f"{t}, {SEGMENTS}, {REGION} select {_COLUMNS} from region_events",
        "stream_rates": f"""with {ARRIVALS} select camera_name, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as second, count(*) as n from arrivals
            where date_trunc('second', ts) + interval 1 second <= (select max(ts) from arrivals) - interval 10 second group by all""",
        "stream_latest": f"""with {ARRIVALS} select camera_name, event_id, rn, greatest(n - 2, 0) as dropped from (select *, row_number() over (partition by
            camera_name, date_trunc('hour', ts) order by ts desc, event_id desc) as rn, count(*) over (partition by camera_name, date_trunc('hour', ts)) as n
            from arrivals) where rn <= 2""",
        "live_tracks": f"{t} select camera_name, frame_idx, event_id, track_id from tracks",
        "stream_occupancy": f"with {OCCUPANCY} select event_id, event, occupancy from counts",
    }
    of_batch = {"stream_departures": "departures", "stream_departure_views": "departure_views", "stream_maturity": "tracklet_maturity", "stream_summary": "session_summary"}
    return found | {name: found[same] for name, same in of_batch.items()}


def _hard(strict: bool) -> str:
    negative = "a.label <> b.label" if strict else "(a.label <> b.label or a.id = b.id)"
    return f"""with {FEATURES}, d as (select a.id // {fx.BATCH} as batch, a.id, max(case when a.label = b.label and a.id <> b.id then d end) as far,
        min(case when {negative} then d end) as near
        from (select a.id as i, b.id as j, sqrt(greatest(0, list_inner_product(a.e, a.e) - 2 * list_inner_product(a.e, b.e) + list_inner_product(b.e,
        b.e)) + 1e-8) as d
              from features a join features b on a.id // {fx.BATCH} = b.id // {fx.BATCH}) p join features a on a.id = i join features b on b.id = j
              group by 1, 2)
        select batch, count(*) as anchors, round(avg(greatest(0, far - near + 0.3)), {6 if strict else 3}) as loss from d
        where far > 0 and near < 1e6 group by batch"""
