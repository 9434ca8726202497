"""DuckDB's SQL of the queries in ``expressions``, written from their definitions and not from their Spark form."""

from __future__ import annotations

from . import fixtures as fx
from .expressions import NOTCHED
from .oracle import BOXES, IMAGES, LINES, OCCUPANCY, SEGMENTS, SIMILAR, TRACKS

_EDGES = "edges(ax, ay, zx, zy) as (values " + ", ".join(f"({x}.0, {y}.0, {NOTCHED[i - 1][0]}.0, {NOTCHED[i - 1][1]}.0)" for i, (x,
    y) in enumerate(NOTCHED)) + """)"""
_MID = "cast(floor((b1 + b2) / 2.0) as bigint)"
_SIX = "cast(cast(cast({} as decimal(18, 12)) as decimal(18, 6)) as varchar)"


def oracle_sql() -> dict[str, str]:
    t = f"with {TRACKS}"
    crop = f"least(a2, {fx.FRAME_W}) - greatest(a1, 0) >= {{}} and least(b2, {fx.FRAME_H}) - greatest(b1, 0) >= {{}}"
    return {
        "box_points": f"""{t}, {SEGMENTS} select event_id, fx as px, b2 as foot_y, {_MID} as center_y, b1 as top_y,
            cast(floor(({_MID} + b2) / 2.0) as bigint) as mid_foot_y,
            cast(floor((x1 + x2) / 2) as bigint) as raw_x, y2 as raw_y from feet""",
        "line_sides": f"""{t}, {LINES}, {SEGMENTS},
            p as (select event_id, l.*, fx as px, case l.kind when 'center' then {_MID} when 'top' then b1 when 'mid-foot'
            then cast(floor(({_MID} + b2) / 2.0) as bigint) else b2 end as py from feet join lines l using (camera_name)),
            c as (select *, (ex - sx) * (py - sy) - (ey - sy) * (px - sx) as cross_, (ex - sx) * (px - sx) + (ey - sy) * (py - sy) as along,
            sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as len from p)
            select event_id, door_id, cast(sign(cross_) as bigint) as side, round(abs(cross_) / len, 6) as distance, round((ex - sx) / len, 6) as ux,
            round((ey - sy) / len, 6) as uy,
            along >= 0 and along <= (ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) as within_ends from c""",
        "calibrated_lines": f"""{t}, {LINES} select camera_name, door_id, count(*) as n from tracks join lines using (camera_name)
            where camera_name <> 'Camera_3' group by all""",
        "notched_region": f"""{t}, {SEGMENTS}, {_EDGES} select event_id, sum(case when (ay > b2) <> (zy > b2)
            and fx < (zx - ax) * (b2 - ay) / (zy - ay) + ax then 1 else 0 end) % 2 = 1 as inside
            from feet cross join edges group by event_id""",
        "usable_crops": f"""{t}, {SEGMENTS} select event_id, {crop.format(32, 64)} as for_embedding, {crop.format(50, 50)} as for_saving,
            track_id * 7919 % 10000 as colour from whole""",
        "brightness_bands": """select case when b > 90 then null when b > 50 then 1.5::double else 3.0::double end as clip, b < 50 as gamma, count(*) as n
            from (select cast(floor(value) as bigint) % 120 as b from events) group by all""",
        "source_kinds": r"""select page_id, case when regexp_matches(lower(source), '^(rtsp|http|https)://') then 'stream' when page_id % 3 = 1
            then 'webcam' else 'file' end as kind,
            regexp_replace(regexp_extract(source, '([^/\\]+)$', 1), '\.[^.]*$', '') as stem,
            lower(source) like '%.jpg' or lower(source) like '%.png' as is_image
            from (select page_id, case page_id % 3 when 0 then url when 1 then cast(page_id as varchar) else concat('clips/rot', page_id,
            '.part.JPG') end as source from pages)""",
        "rotation_numbers": "select case when page_id % 4 = 0 then 9999 else page_id % 17 end as rotation, count(*) as n from pages group by 1",
        "display_points": f"{t} select event_id, 0.625::double as scale, cast(trunc((y2 + 0.1) / 0.625) as bigint) as source_y from tracks",
        "band_zones": f"""{t}, {LINES}, c as (select *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as len from lines),
            q as (select *, -(ey - sy) / len * band as nx, (ex - sx) / len * band as ny from c),
            k as (select camera_name, door_id, 0 as corner, sx + nx as x, sy + ny as y from q union all select camera_name, door_id, 1, ex + nx, ey + ny from q
                  union all select camera_name, door_id, 2, ex - nx, ey - ny from q union all select camera_name, door_id, 3, sx - nx, sy - ny from q)
            select camera_name, door_id, cast(corner as bigint) as corner, cast(trunc(x) as bigint) as x, cast(trunc(y) as bigint) as y, n
            from k join (select camera_name, count(*) as n from tracks group by 1) using (camera_name)""",
        "reported_rates": """select cast(case when f between 1 and 60 then f else 25 end as double) as fps, count(*) as n
            from (select cast(floor(value) as bigint) % 80 as f from events) group by 1""",
        "vector_pairs": f"""with {SIMILAR}, p as (select a.id, a.e as a, b.e as b, a.e as own, u.u, v.u as w from features a
            join features b on b.id = a.id + 1 join units u on u.id = a.id join units v on v.id = b.id)
            select id, round(list_inner_product(u, w), 6) as cosine, round(list_inner_product(a, a) - 2 * list_inner_product(a,
            b) + list_inner_product(b, b), 6) as squared,
            round(sqrt(greatest(0, list_inner_product(a, a) - 2 * list_inner_product(a, b) + list_inner_product(b, b)) + 1e-8), 6) as distance,
            round(sqrt(list_inner_product(u, u)), 6) as length, len(list_filter(own, lambda x: x <> 0)) > 0 as is_nonzero from p""",
        "learning_rates": "select event_id // 100 as epoch, count(*) as n, round(3e-4 * pow(0.5, event_id // 100 // 15), 12) as lr from events group by all",
        "label_files": f"""{t}, {BOXES}, l as (select image_id, event_id, concat_ws(' ', '0',
            {_SIX.format('least(1, greatest(0, (x0 + w0 / 2) / width))')}, {_SIX.format('least(1, greatest(0, (y0 + h0 / 2) / height))')},
            {_SIX.format('least(1, greatest(0, w0 / width))')}, {_SIX.format('least(1, greatest(0, h0 / height))')}) as line from cut
            where w > 0 and h >= 70 and w0 > 0 and h0 > 0)
            select image_id, string_agg(line, chr(10) order by event_id) as text from l group by 1""",
        "dataset_check": f"""with {IMAGES}, wanted(subdir, at_least) as (values ('a/day', 10), ('a/night', 10), ('b/day', 1000000), ('c/day', 1)),
            c as (select concat(dataset, '/', kind) as subdir, count(*) as n from images group by 1)
            select subdir, coalesce(n, 0) as images, coalesce(n, 0) >= at_least as ok from wanted left join c using (subdir)""",
        "capped_images": f"with {IMAGES} select path from (select path from images where kind = 'day' order by md5(concat('42:', path)), path limit 20)",
        "first_candidates": f"with {IMAGES} select path as name, case kind when 'day' then concat('copy/', path) else path end as path from images",
        "frame_counts": f"{t} select camera_name, frame_idx, count(*) as detections from tracks group by all",
        "frame_latency": """select count(*) as frames, round(count(*) / cast(sum(event_id % 37 + 1) as double), 6) as fps,
            round(1000.0 * sum(event_id % 37 + 1) / count(*), 6) as ms_per_frame from events""",
        "last_epoch": "select event_id // 100 as epoch, count(*) as n, round(avg(value), 6) as loss from events group by 1 order by 1 desc limit 1",
        "logged_events": f"""with {OCCUPANCY} select strftime(ts, '%Y-%m-%d') as event_date, door_id, event, count(*) as n, max(occupancy) as highest
            from counts group by all""",
    }
