"""DuckDB's SQL of the queries in ``files``: what the readers must find, from the tables that the files were made of."""

from __future__ import annotations

from . import fixtures as fx
from .oracle import ARRIVALS, FEATURES, IMAGES, LINES, OCCUPANCY, SEGMENTS, TRACKS

W, H = fx.FRAME_W, fx.FRAME_H
#: Whole-pixel boxes with their place in the image's order, and the part of each that the frame holds.
WHOLE = f"""
boxes as (select concat(camera_name, '_', frame_idx) as image_id, camera_name, frame_idx, event_id, cast(trunc(x1) as bigint) as x,
cast(trunc(y1) as bigint) as y,
                 cast(trunc(x2) as bigint) - cast(trunc(x1) as bigint) as w, cast(trunc(y2) as bigint) - cast(trunc(y1) as bigint) as h from tracks),
placed as (select *, row_number() over (partition by image_id order by event_id) - 1 as place, count(*) over (partition by image_id) as many from boxes)"""


def _cut(width: str, height: str) -> str:
    """Shares of the frame, from ``placed``, as ``cut``."""
    return f"""
sized as (select *, {width} as fw, {height} as fh from placed),
inner_ as (select *, greatest(x, 0) as x0, greatest(y, 0) as y0, least(w, fw - greatest(x, 0)) as w0, least(h, fh - greatest(y, 0)) as h0 from sized),
cut as (select *, least(1, greatest(0, (x0 + w0 / 2.0) / fw)) as xc, least(1, greatest(0, (y0 + h0 / 2.0) / fh)) as yc,
               least(1, greatest(0, w0 / cast(fw as double))) as wn, least(1, greatest(0, h0 / cast(fh as double))) as hn from inner_
               where w > 0 and h > 0 and w0 > 0 and h0 > 0)"""


#: Shares of these frames end within twelve digits or never, so none is a tie.
SHARES = "round(xc, 12) as xc, round(yc, 12) as yc, round(wn, 12) as w, round(hn, 12) as h"
#: Number n of a name in a list, from an order's remainder.
_CITY = "['Pedestrian', 'person', 'rider', 'people'][event_id % 4 + 1]"
_CORNER = "['Pedestrian', 'person', 'RIDER', 'bicyclist', 'car'][event_id % 5 + 1]"
_MID = "cast(floor((b1 + b2) / 2.0) as bigint)"


def _crowd(box: str) -> str:
    x, y, w, h = (f"case when {box} then {seen} else case when event_id % 5 <> 0 then {full} end end" for seen, full in (("x", "x"), ("y", "y"), ("9", "w"), ("9", "h")))
    return f"with {TRACKS}, {WHOLE}, s as (select image_id, place as \"order\", {x} as x, {y} as y, {w} as w, {h} as h from placed where event_id % 7 <> 0) select * from s where x is not null"


def _counted(labels: str) -> str:
    return f"""with {TRACKS}, {WHOLE} select concat(image_id, '.jpg') as image_id, x, y, w, h from placed
        where image_id not like '%7' and place < greatest(many - 1, 1) and event_id % 9 <> 0 and event_id % 5 + 1 in {labels}"""


_DOCUMENTS = f"""{TRACKS}, {WHOLE}, kept as (select * from placed where frame_idx % 10 <> 3 and event_id % 3 + 4 = case camera_name when 'Camera_3'
    then 4 else 5 end)"""

_LINE_DEFAULTS = """
shaped as (select camera_name, door_id, sx, sy, ex, ey, case when camera_name = 'Camera_2' and door_id = 'Door_B' then 'exit' else 'both' end as direction,
                  case when camera_name = 'Camera_2' then case door_id when 'Door_B' then 'mid-foot' else 'top' end else 'foot' end as crossing_point,
                  case when camera_name = 'Camera_2' and door_id = 'Door_B' then 40 else 25 end as band_width from lines)"""

_MOVED = [(50, 50), (300, 60), (310, 700), (40, 640)]
_NEW = [(0, 0), (640, 0), (640, 720)]


def _edges(polygon: list[tuple[int, int]]) -> str:
    return ", ".join(f"({x}.0, {y}.0, {polygon[i - 1][0]}.0, {polygon[i - 1][1]}.0)" for i, (x, y) in enumerate(polygon))


def oracle_sql() -> dict[str, str]:
    t = f"with {TRACKS}"
    sources = """sources(name, source, kind) as (values ('Camera_1', 'rtsp://door/1', 'stream'), ('Camera_2', '0', 'webcam'), ('Camera_3',
        'clips\\door.mp4', 'file'), ('Camera_4', 'HTTPS://door/4', 'stream'))"""
    corner = [f"(cast(floor(value) as bigint) % 7 + {k}) % 4 > 0 or (event_id % 5 + {k}) % 3 > 0" for k in range(5)]
    return {
        "camera_list": f"{t}, {sources} select name, source, kind, count(*) as n from sources join tracks on camera_name = name group by all",
        "counter_lines": f"""{t}, {LINES}, {SEGMENTS}, {_LINE_DEFAULTS},
            p as (select l.*, fx as px, case crossing_point when 'top' then b1 when 'mid-foot' then cast(floor(({_MID} + b2) / 2.0) as bigint)
            else b2 end as py from feet join shaped l using (camera_name))
            select camera_name, door_id, direction, crossing_point, band_width,
            count(*) filter (abs((ex - sx) * (py - sy) - (ey - sy) * (px - sx)) / sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) <= band_width) as n
            from p group by all""",
        "counter_regions": f"""{t}, {SEGMENTS}, edges(ax, ay, zx, zy) as (values {_edges(_MOVED)}),
            s as (select event_id, sum(case when (ay > {_MID}) <> (zy > {_MID}) and fx < (zx - ax) * ({_MID} - ay) / (zy - ay) + ax then 1
            else 0 end) % 2 = 1 as inside
                  from feet cross join edges where camera_name = 'Camera_1' group by event_id)
            select 'Camera_1' as camera_name, 'Room' as room, 4 as points, 'center' as crossing_point, 'line' as crossing_mode,
            count(*) filter (inside) as n_inside from s
            union all select 'Camera_4', null, 3, 'foot', 'line', null""",
        "polygon_validity": f"""select event_id, event_id % 4 + 2 >= 3
            and {' and '.join(f'(event_id % 4 + 2 <= {k} or {c})' for k, c in enumerate(corner))} as is_valid from events""",
        "crowd_full_boxes": _crowd("false"),
        "crowd_visible_boxes": _crowd("event_id % 2 = 0"),
        "city_boxes": f"""{t}, {WHOLE}, {_cut(f"case camera_name when 'Camera_2' then 2048 else {W} end", f"case camera_name when 'Camera_2' then 1024 else {H} end")}
            select concat(camera_name, '_', image_id, '_leftImg8bit.png') as image_id, place, {SHARES} from cut
            where h >= 10 and lower({_CITY}) in ('pedestrian', 'person')""",
        "city_boxes_unoccluded": f"""{t}, {WHOLE} select camera_name as city, case camera_name when 'Camera_2' then 2048 else {W} end as width,
            case camera_name when 'Camera_2' then 1024 else {H} end as height,
            count(*) as n, cast(sum(h) as double) as heights from placed where event_id % 3 <> 1 and lower({_CITY}) in ('pedestrian', 'person') group by 1""",
        "corner_boxes": f"""{t}, {WHOLE}, {_cut(str(W), str(H))} select concat('night_', camera_name, '_', image_id) as image_id, place, {SHARES} from cut
            where camera_name <> 'Camera_4' and event_id % 11 <> 0 and event_id % 13 <> 0 and lower({_CORNER}) in ('pedestrian', 'person')
            and round(hn, 6) * {H} >= 90""",
        "corner_boxes_with_riders": f"""{t}, {WHOLE} select camera_name as city, count(*) as n, cast(sum(w) as double) as widths from placed
            where camera_name <> 'Camera_4' and event_id % 11 <> 0 and event_id % 13 <> 0 and {_CORNER} <> 'car'
            and (event_id % 2 = 1 or event_id % 10 <= 5) group by 1""",
        "counted_boxes": _counted("(1)"),
        "counted_boxes_of_all": _counted("(1, 2, 3)"),
        "document_boxes": f"with {_DOCUMENTS} select image_id, x, y, w, h from kept",
        "document_counts": f"with {_DOCUMENTS} select camera_name as document, count(*) as persons, count(distinct image_id) as images from kept group by 1",
        "image_listing": """select concat('d', page_id % 3) as folder, concat('page', page_id) as image_id, cast(1 as bigint) as length from pages
            where page_id % 6 in (0, 1, 3, 4)""",
        "written_labels": f"{t}, {WHOLE}, {_cut(str(W), str(H))} select image_id, count(*) as n_lines, false as ends_open from cut where h >= 70 group by 1",
        "summary_file": f"""with {OCCUPANCY} select 'Room' as room, (select arg_max(occupancy, ts) from counts) as final_occupancy, (select max(peak)
            from peaks) as peak_occupancy, door_id,
            count(*) filter (event = 'ENTRY') as entered, count(*) filter (event = 'EXIT') as exited from doors group by door_id""",
        "occupancy_snapshot": f"""with {OCCUPANCY} select 'Room' as room, arg_max(occupancy, ts) as current_occupancy,
            count(*) filter (event = 'ENTRY') as total_entered,
            count(*) filter (event = 'EXIT') as total_exited, (select max(peak) from peaks) as peak_occupancy, count(distinct door_id) as doors from counts""",
        "rotation_manifests": f"""with {IMAGES}, d as (select count(*) as n from images where kind = 'day') select rotation,
            count(*) + any_value(d.n) as n_lines, count(*) + any_value(d.n) as n_images
            from rotated, d where rotation >= 0 group by rotation""",
        "rotation_descriptions": f"""with {IMAGES}, r as (select distinct rotation from rotated where rotation >= 0) select concat('rot', rotation) as name,
            concat('# Rotation ', rotation + 1, '/', (select count(*) from r), chr(10), 'train: data/rotation=', rotation, chr(10), 'val: data/val',
            chr(10), 'nc: 1', chr(10), 'names:', chr(10), '  0: person', chr(10)) as text from r""",
        "validation_images": f"with {IMAGES} select path from (select path from images order by md5(concat('42:', path)), path limit 21)",
        "day_only_rotation": f"""with {IMAGES} select cast(0 as bigint) as rotation, count(*) as day, cast(0 as bigint) as night,
            0.0::double as night_percent from images where kind = 'day'""",
        "later_rotations": f"""with {IMAGES}, r as (select distinct rotation from rotated where rotation >= 1)
            select 'from 2' as asked, rotation, 0.0005::double as lr, concat('rot', rotation - 1, '/best.pt') as weights_in from r where rotation >= 2
            union all select 'only 1', rotation, 0.0005::double, 'rot0/best.pt' from r where rotation = 1""",
        "chained_weights": f"""with {IMAGES}, r as (select rotation, count(*) as n, case when rotation % 3 <> 1 then concat('rot', rotation,
            '.pt') end as weights_out from rotated where rotation >= 0 group by rotation)
            select *, last_value(weights_out ignore nulls) over (order by rotation rows between unbounded preceding and 1 preceding) as starts_from from r""",
        "metrics_report": "select " + ", ".join(f"round(100.0 * count(*) filter (event_type = '{k}') / count(*), 3) as \"{k}\"" for k in ("view",
            "click", "error")) + """ from events""",
        "sweep_results": """select cast(l_linenumber * 5 / 100.0 as double) as conf, 0.45::double as iou, l_linenumber * 32 as imgsz,
            cast(count(*) % 100 / 100.0 as double) as "precision",
            cast(cast(sum(cast(l_quantity as bigint)) as bigint) % 100 / 100.0 as double) as recall, 0.5::double as map50, 0.25::double as map50_95
            from lineitem where l_returnflag <> 'N' group by l_linenumber, l_returnflag""",
        "run_results": """with r as (select event_id // 100 as run, count(*) as n, max(event_id) as last from events group by 1)
            select concat('run', run) as run, case when run % 4 in (0, 3) then 'json' else 'csv' end as source, case when run % 4 in (0, 3)
            then 'json' else 'csv' end as epoch,
            cast(case when run % 4 in (0, 3) then n else last end as varchar) as loss from r""",
        "data_set_verdict": f"""with {IMAGES}, wanted(subdir, at_least) as (values ('a/day', 10), ('a/night', 10), ('b/day', 1000000), ('b/night',
            1), ('c/day', 1)),
            c as (select concat(dataset, '/', kind) as subdir, count(*) as n from images group by 1), k as (select subdir, coalesce(n,
            0) >= at_least as good from wanted left join c using (subdir))
            select split_part(subdir, '/', 1) as dataset, bool_and(good) as ok, count(*) as checks, count(*) filter (not good) as failed from k group by 1""",
        "frame_ratios": f"""{t} select camera_name, round(count(*) / cast(count(distinct frame_idx) as double), 6) as per_frame,
            cast(count(*) as double) as of_none from tracks group by 1""",
        "written_frames": f"""with {ARRIVALS}, g as (select camera_name, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by camera_name
            order by ts, event_id)) / 1e6 as d from arrivals),
            c as (select camera_name, case when d is null then 1 else greatest(1, least(cast(round_even(d * 0.01, 0) as bigint), 8)) end as copies from g)
            select camera_name, cast(sum(copies) as bigint) as written, max(copies) as most from c group by 1""",
        "combined_loss": f"""with {FEATURES}, p as (select a.e as a, b.e as b, c.e as c from features a join features b on b.id = a.id + 1
            join features c on c.id = a.id + 2 where a.id % 3 = 0),
            l as (select avg(greatest(0, pow(list_distance(a, b), 2) - pow(list_distance(a, c), 2) + 0.3)) as triplet from p),
            x as (select avg(ln(list_sum(list_transform(e[1:10], lambda x: exp(x)))) - e[id % 10 + 1]) as entropy from features)
            select round(triplet + 0.5 * entropy, 6) as loss, 'both' as kind from l, x union all select round(2 * triplet, 6), 'triplet' from l""",
    }
