"""DuckDB SQL over the given tables for queries of the catalog, written apart from the operators."""

from __future__ import annotations

from shapelake.sources import tables as t


def _rounded(sql: str, columns: str, digits: int) -> str:
    """Rounds the named columns of a statement and keeps the others."""
    names = columns.split()
    each = ", ".join(f"round({c}, {digits}) + 0.0 {c}" for c in names)
    return f"select * exclude ({', '.join(names)}), {each} from ({sql})"


def even(x: str, d: int) -> str:
    """Half to even on the scaled value."""
    return f"(round_even(({x}) * 1e{d}, 0) / 1e{d})"


def ratio(a: str, b: str, d: int) -> str:
    return f"(case when ({b}) > 1e-5 then {even(f'({a}) / ({b})', d)} else 0 end)"


O = f"o as ({t.OUTLINES})"
NEXT = f"""{O}, v as (select *,
  coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny,
  coalesce(lag(x) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) px,
  coalesce(lag(y) over w, last_value(y) over (w rows between unbounded preceding and unbounded following)) py
  from o window w as (partition by outline_id order by seq))"""
LEN = "sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y))"
TURN = f"""(case when {LEN} < 1e-10 or sqrt((x-px)*(x-px) + (y-py)*(y-py)) < 1e-10 then 0
  else atan2((x-px)*(ny-y) - (y-py)*(nx-x), (x-px)*(nx-x) + (y-py)*(ny-y)) * 180 / pi() end)"""

PERIMETER_AREA = f"""with {NEXT} select outline_id, count(*) n, sum({LEN}) perimeter, sum(x*ny - y*nx) / 2 signed_area,
  abs(sum(x*ny - y*nx) / 2) area from v group by 1"""

SHAPE = f"""with {NEXT}, a as (select *, {TURN} turn from v), m as (
  select outline_id, count(*) n, sum({LEN}) perimeter, abs(sum(x*ny - y*nx) / 2) area, min(x) min_x, min(y) min_y, max(x) max_x,
    max(y) max_y, {even("sum(abs(turn))", 4)} sum_turning, {even("var_pop(abs(turn))", 4)} var_turning from a group by 1)
select *, {even("sum_turning / n", 4)} mean_turning, {ratio("max_x - min_x", "max_y - min_y", 2)} aspect_ratio,
  {ratio("perimeter", "area", 4)} perimeter_area_ratio,
  case when perimeter > 1e-5 then {even("4 * pi() * area / (perimeter * perimeter)", 4)} else 0 end circularity from m"""

EFD = f"""{NEXT}, s as (select *, {LEN} step, sum({LEN}) over (partition by outline_id order by seq) upto,
    sum({LEN}) over (partition by outline_id) total from v), h as (
  select outline_id, harmonic, total, (nx-x)/step ux, (ny-y)/step uy, 2*pi()*harmonic/total*upto a1, 2*pi()*harmonic/total*(upto-step) a0
  from s cross join (select unnest(range(1, 11)) harmonic) where step >= 1e-10), efd as (
  select outline_id, harmonic, any_value(total) / (2*harmonic*harmonic*pi()*pi()) k,
    sum(ux*(cos(a1)-cos(a0))) a, sum(ux*(sin(a1)-sin(a0))) b, sum(uy*(cos(a1)-cos(a0))) c, sum(uy*(sin(a1)-sin(a0))) d
  from h group by 1, 2), raw as (select outline_id, harmonic, k*a a, k*b b, k*c c, k*d d from efd)"""
NORM = f"""{EFD}, f as (select outline_id, a a1, b b1, c c1, d d1, 0.5*atan2(2*(a*b+c*d), a*a-b*b+c*c-d*d) th from raw where harmonic = 1),
  g as (select *, a1*cos(th)+b1*sin(th) sa, c1*cos(th)+d1*sin(th) sc from f),
  p as (select outline_id, th, atan2(sc, sa) ps, sqrt(sa*sa+sc*sc) z from g),
  r as (select outline_id, harmonic, ps, z, a*cos(harmonic*th)+b*sin(harmonic*th) a, b*cos(harmonic*th)-a*sin(harmonic*th) b,
    c*cos(harmonic*th)+d*sin(harmonic*th) c, d*cos(harmonic*th)-c*sin(harmonic*th) d from raw join p using (outline_id)),
  norm as (select outline_id, harmonic, (a*cos(ps)+c*sin(ps))/z a, (b*cos(ps)+d*sin(ps))/z b, (c*cos(ps)-a*sin(ps))/z c,
    (d*cos(ps)-b*sin(ps))/z d from r)"""
SERIES = """select outline_id, sample, sum(a*cos(harmonic*2*pi()*sample/200)+b*sin(harmonic*2*pi()*sample/200)) x,
  sum(c*cos(harmonic*2*pi()*sample/200)+d*sin(harmonic*2*pi()*sample/200)) y
  from {efd} cross join (select unnest(range(201)) sample) group by 1, 2"""


def _ops(size: int) -> str:
    at = ", ".join(f"max(case when s = {k} then {c} end) {c}{k + 1}" for k in range(size) for c in "xy")
    return f"""c as ({t.CLICKS}), k as (select *, (click_seq-1)//{size} op_seq, (click_seq-1)%{size} s from c),
  ops as (select session_id, op_seq, {at} from k group by 1, 2 having count(*) = {size})"""


_D = lambda i, j: f"sqrt((x{i}-x{j})*(x{i}-x{j}) + (y{i}-y{j})*(y{i}-y{j}))"
_A = lambda p, q, r: even(
    f"abs(atan2((x{q}-x{p})*(y{r}-y{p}) - (y{q}-y{p})*(x{r}-x{p}), (x{q}-x{p})*(x{r}-x{p}) + (y{q}-y{p})*(y{r}-y{p}))) * 180 / pi()", 2
)
TRIANGLE = f"""with {_ops(3)}, m as (select *, abs((x2-x1)*(y3-y1) - (y2-y1)*(x3-x1)) tw, greatest({_D(1, 2)}, {_D(2, 3)}, {_D(3, 1)}) longest from ops),
  a as (select session_id, op_seq, tw < 1e-4 is_degenerate, case when tw >= 1e-4 then {_A(1, 2, 3)} end angle_a,
    case when tw >= 1e-4 then {_A(2, 1, 3)} end angle_b, case when tw >= 1e-4 then {_A(3, 1, 2)} end angle_c,
    case when tw >= 1e-4 then tw / 2 end area, longest from m)
select session_id, op_seq, is_degenerate, angle_a, angle_b, angle_c, area,
  case when prev > 1e-5 then {even("area / prev", 2)} end relative_area,
  case when area is not null then {ratio("longest", "case when area > 1e-5 then area * 2 / longest else 0 end", 2)} end aspect_ratio
from (select *, last_value(area ignore nulls) over (partition by session_id order by op_seq rows between unbounded preceding and 1 preceding) prev from a)"""
SHAPES = f"""with {_ops(2)}, m as (select *, ['square', 'circle', 'rectangle', 'ellipse'][op_seq % 4 + 1] kind, abs(x2-x1) w, abs(y2-y1) h from ops),
  a as (select session_id, op_seq, kind, case when kind in ('square', 'circle') then greatest(w, h) else w end width,
    case when kind in ('square', 'circle') then greatest(w, h) else h end height from m),
  b as (select *, case when kind in ('circle', 'ellipse') then pi() * (width/2) * (height/2) else width * height end area from a)
select session_id, op_seq, kind, width, height, area, {ratio("width", "height", 2)} aspect_ratio,
  case when prev > 1e-5 then {even("area / prev", 2)} end relative_area
from (select *, lag(area) over (partition by session_id order by op_seq) prev from b)"""
LINES = f"""with {_ops(2)}, m as (select session_id, op_seq, {_D(1, 2)} length, atan2(y2-y1, x2-x1) * 180 / pi() g from ops)
select session_id, op_seq, length, case when g < 0 then g + 360 else g end angle,
  case when prev > 1e-5 then {even("length / prev", 2)} end relative_length
from (select *, last_value(case when length > 1e-5 then length end ignore nulls)
  over (partition by session_id order by op_seq rows between unbounded preceding and 1 preceding) prev from m)"""
# Lines under a mode: the first long enough line of a run of one mode is free and turns into the direction of the others.
CONSTRAINED = LINES.replace(_ops(2), f"""{_ops(2).replace("ops as", "raw as")},
  md as (select *, ['none', 'parallel', 'perpendicular', 'angle'][op_seq // 3 % 4 + 1] mode, {_D(1, 2)} len from raw),
  rn as (select *, sum(case when mode = was then 0 else 1 end) over (partition by session_id order by op_seq) run
    from (select *, lag(mode) over (partition by session_id order by op_seq) was from md)),
  rf as (select *, first_value(case when mode <> 'none' and len > 1e-3 then [(x2-x1) / len, (y2-y1) / len] end ignore nulls)
    over (partition by session_id, run order by op_seq rows between unbounded preceding and 1 preceding) u from rn),
  dr as (select *, case mode when 'parallel' then u when 'perpendicular' then [-u[2], u[1]]
    else [u[1]*cos(pi()/6) - u[2]*sin(pi()/6), u[1]*sin(pi()/6) + u[2]*cos(pi()/6)] end way from rf),
  ft as (select *, (x2-x1)*way[1] + (y2-y1)*way[2] foot, mode = 'none' or u is null free from dr),
  ops as (select session_id, op_seq, x1, y1, case when free then x2 else x1 + way[1]*foot end x2, case when free then y2 else y1 + way[2]*foot end y2 from ft)""")
# The bisector's point lies at the signed distance e from the chord of length l: radius and angle follow from l and e.
# A chord's third click is the first one after it that makes no flat arc; the click after that begins the next chord.
_FLAT = """(power(b.x-a.x, 2) + power(b.y-a.y, 2) > 0 and abs((b.x-a.x)*(z.y-a.y) - (b.y-a.y)*(z.x-a.x))
    <= 1e-5 * ((power(b.x-a.x, 2) + power(b.y-a.y, 2)) / 4 + power((b.x-a.x)*(z.y-a.y) - (b.y-a.y)*(z.x-a.x), 2) / (power(b.x-a.x, 2) + power(b.y-a.y, 2))))"""
_ARC_OPS = f"""c as ({t.CLICKS}), k as materialized (select *, click_seq - 1 n from c),
  nx as materialized (select a.session_id, a.n, min(z.n) e from k a join k b on b.session_id = a.session_id and b.n = a.n + 1
    join k z on z.session_id = a.session_id and z.n > b.n and not {_FLAT} group by 1, 2),
  ch(session_id, n) as (select distinct session_id, 0::bigint from k union all select session_id, e + 1 from ch join nx using (session_id, n)),
  ops as (select session_id, row_number() over (partition by session_id order by n) - 1 op_seq, a.x x1, a.y y1, b.x x2, b.y y2, z.x x3, z.y y3
    from ch join nx using (session_id, n) join k a using (session_id, n) join k b on b.session_id = a.session_id and b.n = a.n + 1
    join k z on z.session_id = a.session_id and z.n = e)"""
ARCS = f"""with recursive {_ARC_OPS}, m as (select *, {_D(1, 2)} l, ((x2-x1)*(y3-(y1+y2)/2) - (y2-y1)*(x3-(x1+x2)/2)) / {_D(1, 2)} h, abs(h) e from ops),
  r as (select session_id, op_seq, l, e, h, l * e / (l*l/4 + e*e) det, (l*l/4 + e*e) / (2*e) radius, 720 / pi() * 2 * atan2(2*e, l) / 2 ang from m),
  q as (select *, {even("ang", 2)} central from r)
select session_id, op_seq, coalesce(not det > 1e-5, true) is_flat, case when det > 1e-5 then central end central_angle,
  case when det > 1e-5 then radius end radius, case when det > 1e-5 then {ratio("l", "e", 2)} end chord_rise_ratio,
  case when det > 1e-5 then {ratio("l", "radius * central * pi() / 180", 2)} end chord_arc_ratio, case when det > 1e-5 then e >= l / 2 end is_large_arc,
  case when det > 1e-5 then case when h < 0 then 'clockwise' else 'counterclockwise' end end sweep from q"""
# Half the signed height over the chord gives the parabola a (x - 0.5)^2 - a/4 with a = -4 v.
PARABOLAS = f"""with {_ops(3)}, m as (select *, {_D(1, 2)} l from ops),
  q as (select *, case when l >= 1e-8 then -4 * ((x2-x1)*(y3-(y1+y2)/2) - (y2-y1)*(x3-(x1+x2)/2)) / (l*l) else 0 end a from m),
  z as (select session_id, op_seq, sum(sqrt(1/4096.0 + pow(a*((i+1)/64.0*((i+1)/64.0-1) - i/64.0*(i/64.0-1)), 2))) * any_value(l) arc
    from q cross join (select unnest(range(64)) i) where l >= 1e-8 group by 1, 2)
select session_id, op_seq, a, {ratio("abs(a) / 4 * l", "l", 3)} rise_span_ratio, {even("abs(2*a)", 5)} vertex_curvature,
  coalesce({ratio("l", "arc", 2)}, 0) chord_arc_ratio, printf('y = %.3fx² + %.3fx + %.3f', a + 0.0, 0.0 - a, 0.0::double) equation
from q left join z using (session_id, op_seq)"""
# Histories as two lists of event numbers; below a surviving operation lies what lay there when it was committed.
REPLAYED = f"""lg as materialized ({t.OP_LOG}), h(session_id, event_seq, done, undone) as (
    select distinct session_id, 0::bigint, []::bigint[], []::bigint[] from lg union all
    select lg.session_id, lg.event_seq,
      case when action = 'commit' then list_append(done, lg.event_seq) when action = 'undo' then done[:greatest(len(done), 1) - 1]
        when len(undone) > 0 then list_append(done, undone[-1]) else done end,
      case when action = 'commit' then []::bigint[] when action = 'redo' then undone[:greatest(len(undone), 1) - 1]
        when len(done) > 0 then list_append(undone, done[-1]) else undone end
    from h join lg on lg.session_id = h.session_id and lg.event_seq = h.event_seq + 1),
  top as (select session_id, max_by(done, event_seq) done from h group by 1),
  rp as (select session_id, event_seq op_seq, kind, measure, lag(measure) over (partition by session_id, kind order by event_seq) previous
    from (select session_id, unnest(done) event_seq from top) join lg using (session_id, event_seq))"""
LATEST = f"""with recursive {REPLAYED}, l as (select session_id, max_by(kind, op_seq) kind, max_by(measure, op_seq) measure, arg_max_null(previous, op_seq) previous from rp group by 1)
select session_id, kind, coalesce(measure, 0) measure, case when previous > 1e-5 then {even("measure / previous", 2)} end relative from top left join l using (session_id)"""

P = f"p as ({t.PIXELS.replace('{grid}', t.DUCK_GRID)})"
DIST = """sqrt(2*({a}r-{b}r)*({a}r-{b}r) + 4*({a}g-{b}g)*({a}g-{b}g) + 3*({a}b-{b}b)*({a}b-{b}b))"""
_CH = lambda c: (
    f"cast(trunc(greatest(0, least(1, ((l + ({c}/255.0e0 - l) * 1.3e0 - 0.1e0) - 0.5e0) * 1.2e0 + 0.5e0)) * 255) as bigint) {c}"
)
ADJUST = f"""with {P} select image_id, x::bigint x, y::bigint y, {_CH("r")}, {_CH("g")}, {_CH("b")}
  from (select *, 0.299e0*r/255.0e0 + 0.587e0*g/255.0e0 + 0.114e0*b/255.0e0 l from p)"""
DOWNSAMPLE = f"""with {P}, d as (select unnest(range(17)) dx), e as (select unnest(range(17)) dy)
select image_id, dx x, dy y, r::bigint r, g::bigint g, b::bigint b from d cross join e join p on p.x = floor(dx/17.0e0*32) and p.y = floor(dy/17.0e0*32)"""
CORNERS = f"""corner as (select image_id, (case when x >= 27 then 1 else 0 end) + (case when y >= 27 then 2 else 0 end) corner, avg(r) r, avg(g) g, avg(b) b
  from p where (x between 1 and 4 or x between 27 and 30) and (y between 1 and 4 or y between 27 and 30) group by 1, 2)"""
THRESHOLD = f"""with {P}, {CORNERS}, m as (select image_id, avg(r) mr, avg(g) mg, avg(b) mb from corner group by 1)
select image_id, greatest(35, least(60, 35 + 0.8e0 * max(sqrt(2*(r-mr)*(r-mr) + 4*(g-mg)*(g-mg) + 3*(b-mb)*(b-mb))))) threshold
from corner join m using (image_id) group by 1"""
SOBEL = f"""with {P}, q as (select image_id, x, y, 2*r+4*g+3*b v from p), k as (
  select p.image_id, p.x, p.y, sum(q.v * (q.x-p.x) * (2 - abs(q.y-p.y))) gx, sum(q.v * (q.y-p.y) * (2 - abs(q.x-p.x))) gy, count(*) n
  from q p join q on q.image_id = p.image_id and abs(q.x-p.x) <= 1 and abs(q.y-p.y) <= 1 group by 1, 2, 3)
select image_id, x::bigint x, y::bigint y, cast(case when n = 9 then gx*gx + gy*gy else 0 end as bigint) gradient from k"""
_BLUR = lambda src: f"""select p.image_id, p.x, p.y, case when count(*) = 9 then sum(q.r)//9 else 0 end r,
  case when count(*) = 9 then sum(q.g)//9 else 0 end g, case when count(*) = 9 then sum(q.b)//9 else 0 end b
  from {src} p join {src} q on q.image_id = p.image_id and abs(q.x-p.x) <= 1 and abs(q.y-p.y) <= 1 group by 1, 2, 3"""  # noqa: E731
BLUR = f"""with {P}, b1 as ({_BLUR("p")}), b2 as ({_BLUR("b1")})
select image_id, x::bigint x, y::bigint y, r::bigint r, g::bigint g, b::bigint b from b2"""
M = f"{P}, m as (select image_id, x, y, ({t.MASK}) inside from p)"
XY = "image_id, x::bigint x, y::bigint y"
# The distance by comparison with every pixel outside; erosion and dilation by the same comparison.
_D1 = lambda src, of: f"select a.image_id, a.x, a.y, a.inside, min(abs(a.x-z.x) + abs(a.y-z.y)) d from {src} a join {src} z on z.image_id = a.image_id and {of} group by 1, 2, 3, 4"
DISTANCE = f"with {M}, k as ({_D1('m', 'not z.inside')}) select {XY}, 32::bigint w, 32::bigint h, inside, d::bigint d from k"
ERODE = f"with {M} select {XY} from m a where inside and not exists (select 1 from m z where z.image_id = a.image_id and not z.inside and abs(a.x-z.x) + abs(a.y-z.y) <= 1)"
DILATE = f"with {M} select distinct a.image_id, a.x::bigint x, a.y::bigint y from m a join m z on z.image_id = a.image_id and z.inside and abs(a.x-z.x) + abs(a.y-z.y) <= 2"
# Opening by 1, then closing by 1, of the blob: each step marks all cells of the picture.
_HIT = lambda src, z: f"exists (select 1 from {src} z where z.image_id = a.image_id and {z} and abs(a.x-z.x) + abs(a.y-z.y) <= 1)"
_SHRINK = lambda src: f"(select image_id, x, y, inside and not {_HIT(src, 'not z.inside')} inside from {src} a)"
_GROW = lambda src: f"(select image_id, x, y, {_HIT(src, 'z.inside')} inside from {src} a)"
OPEN_CLOSE = f"""with {P}, m as (select image_id, x, y, ({t.BLOB}) inside from p), o1 as {_SHRINK("m")}, o2 as {_GROW("o1")},
  c1 as {_GROW("o2")}, c2 as {_SHRINK("c1")} select {XY} from c2 where inside"""
# One pass: the cell that a pixel adds is given by the first rule that holds, as a pair of steps.
_AT = lambda dx, dy: f"exists (select 1 from m z where z.image_id = a.image_id and z.inside and z.x = a.x + {dx} and z.y = a.y + {dy})"
_SIDES = {"n": (0, -1), "e": (1, 0), "s": (0, 1), "w": (-1, 0), "ne": (1, -1), "nw": (-1, -1), "se": (1, 1), "sw": (-1, 1)}
TOPOLOGY = f"""with {M}, k as (select image_id, x, y, {", ".join(f"{_AT(*d)} {k}" for k, d in _SIDES.items())} from m a
    where inside and x between 1 and 30 and y between 1 and 30),
  j as (select *, n::int + e::int + s::int + w::int sides from k),
  c as (select image_id, x, y, case when n and e and not ne then [1, -1] when e and s and not se then [1, 1]
    when s and w and not sw then [-1, 1] when w and n and not nw then [-1, -1]
    when sides = 0 and (ne and sw or nw and se) then [0, -1] when sides < 3 then null
    when not ne then [1, -1] when not nw then [-1, -1] when not se then [1, 1] when not sw then [-1, 1] end g from j)
select {XY} from m where inside union select image_id, (x + g[1])::bigint, (y + g[2])::bigint from c where g is not null"""
_THIN = "exists (select 1 from k z where z.image_id = a.image_id and z.inside and z.d < 2 and abs(a.x-z.x) + abs(a.y-z.y) = 1)"
CORRIDOR = f"with {M}, k as ({_D1('m', 'not z.inside')}) select {XY} from k a where inside and not {_THIN}"
BOUNDS = f"""with {P} select image_id, greatest(0, min(x)-2)::bigint x0, greatest(0, min(y)-2)::bigint y0, least(31, max(x)+2)::bigint x1,
  least(31, max(y)+2)::bigint y1 from p where {t.BLOB} group by 1"""
_NEAR = "s.image_id = r.image_id and abs(s.x-r.x) + abs(s.y-r.y) = 1"
# Every component is spread from each pixel without one to its left or above; the least of those names it.
COMPONENTS = f"""with recursive {M}, s as (select image_id, x, y from m where inside),
  c as (select * from s where not exists (select 1 from s r where r.image_id = s.image_id and (r.x = s.x-1 and r.y = s.y or r.x = s.x and r.y = s.y-1))),
  r(image_id, x, y, root) as (select image_id, x, y, y*32+x from c union select s.image_id, s.x, s.y, r.root from r join s on {_NEAR}),
  q as (select image_id, x, y, min(root) root from r group by 1, 2, 3),
  n as (select image_id, root//32 cy, root%32 cx, count(*) n from q group by 1, 2, 3)"""
HOLES = f"""with recursive {M}, s as (select image_id, x, y from m where not inside),
  r(image_id, x, y) as (select * from s where x in (0, 31) or y in (0, 31) union select s.image_id, s.x, s.y from r join s on {_NEAR})
select image_id, 1024 - count(*) area from r group by 1"""
# The blob without a disc, its holes filled: what border pixels outside do not reach. Of its components the largest.
CARVED = f"""with recursive {P}, m as (select image_id, x, y, ({t.BLOB}) and (x-16)*(x-16) + (y-12)*(y-12) > 9 inside from p), s as (select image_id, x, y from m where not inside),
  r(image_id, x, y) as (select * from s where x in (0, 31) or y in (0, 31) union select s.image_id, s.x, s.y from r join s on {_NEAR}),
  f as materialized (select image_id, x, y from m anti join r using (image_id, x, y)),
  c as (select * from f where not exists (select 1 from f z where z.image_id = f.image_id and (z.x = f.x-1 and z.y = f.y or z.x = f.x and z.y = f.y-1))),
  w(image_id, x, y, root) as (select image_id, x, y, y*32+x from c union select s.image_id, s.x, s.y, r.root from w r join f s on {_NEAR}),
  q as (select image_id, x, y, min(root) root from w group by 1, 2, 3), n as (select image_id, root, count(*) n from q group by 1, 2)
select image_id, max(n) area from n group by 1 having max(n) >= 9"""
# Of one region without holes, every side between inside and outside is one step of the loop.
TRACE = f"""with {P}, m as (select image_id, x, y from p where {t.BLOB})
select m.image_id, sum(4 - (select count(*) from m z where z.image_id = m.image_id and abs(z.x-m.x) + abs(z.y-m.y) = 1))::bigint n,
  sum(4 - (select count(*) from m z where z.image_id = m.image_id and abs(z.x-m.x) + abs(z.y-m.y) = 1))::double perimeter, count(*)::double area from m group by 1"""
# A pair of points is a hull side if no point lies to its right, and none beyond it on its line.
HULL = f"""{O}, pt as (select distinct outline_id, x, y from o), sd as (
  select a.outline_id, a.x, a.y, b.x bx, b.y by_ from pt a join pt b on a.outline_id = b.outline_id and (a.x, a.y) <> (b.x, b.y)
  where not exists (select 1 from pt c where c.outline_id = a.outline_id and ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0
    or (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) = 0 and pow(c.x-a.x, 2) + pow(c.y-a.y, 2) > pow(b.x-a.x, 2) + pow(b.y-a.y, 2)))),
  lo as (select outline_id, min((y, x)) p from sd group by 1)"""
HULL_POINTS = f"""with {HULL} select outline_id, row_number() over (partition by outline_id order by (y, x) <> p, atan2(y - p[1], x - p[2])) - 1 seq, x, y from sd join lo using (outline_id)"""
SOLIDITY = f"""with {HULL}, ar as (select outline_id, sum(x*by_ - y*bx) / 2 hull_area from sd group by 1), pa as ({PERIMETER_AREA.replace("with ", "with ", 1)})
select outline_id, hull_area, {ratio("area", "hull_area", 4)} solidity from pa join ar using (outline_id)"""
SEED = f"""with {P} select image_id, 16::bigint x, 16::bigint y, (sum(r)//count(*))::bigint sr, (sum(g)//count(*))::bigint sg, (sum(b)//count(*))::bigint sb
from p where abs(x-16) <= 2 and abs(y-16) <= 2 group by 1"""
NAMES = f"""with s as ({t.SPECIMENS}) select image_id, coalesce(nullif(trim(name), ''), 'Specimen ' || row_number() over (order by seq, image_id)) specimen_name from s"""
RASTER = f"""with {NEXT}, e as (select outline_id, row, x + (row + 0.5 - y) / (ny - y) * (nx - x) a
  from (select *, unnest(range(ceil(least(y, ny) - 0.5)::bigint, ceil(greatest(y, ny) - 0.5)::bigint)) row from v where y <> ny)),
  k as (select *, lead(a) over (partition by outline_id, row order by a) b, row_number() over (partition by outline_id, row order by a) i from e)
select distinct outline_id image_id, unnest(range(ceil(a - 0.5)::bigint, floor(b - 0.5)::bigint + 1)) x, row y from k where i % 2 = 1 and b is not null"""
CROSS = f"""with {NEXT}, e as (select *, row_number() over (partition by outline_id order by seq) k, count(*) over (partition by outline_id) m from v),
  h as (select distinct a.outline_id from e a join e b on a.outline_id = b.outline_id and b.k > a.k + 1 and not (a.k = 1 and b.k = b.m)
    where ((a.nx-a.x)*(b.y-a.y) - (a.ny-a.y)*(b.x-a.x)) * ((a.nx-a.x)*(b.ny-a.y) - (a.ny-a.y)*(b.nx-a.x)) < 0
      and ((b.nx-b.x)*(a.y-b.y) - (b.ny-b.y)*(a.x-b.x)) * ((b.nx-b.x)*(a.ny-b.y) - (b.ny-b.y)*(a.nx-b.x)) < 0)
select distinct outline_id, outline_id in (select outline_id from h) intersects from o"""
RESAMPLE = f"""{NEXT}, s as (select *, {LEN} step, sum({LEN}) over (partition by outline_id order by seq) - {LEN} begun,
    sum({LEN}) over (partition by outline_id) total, row_number() over (partition by outline_id order by seq) k from v),
  i as (select distinct outline_id, total, greatest(3, round_even(total/4, 0))::bigint c from s),
  j as (select outline_id, c, unnest(range(c)) i, total from i),
  rs as (select j.outline_id, j.i seq, j.c, max_by(s.x + (case when step > 0 then (j.i*j.total/j.c - s.begun)/step else 0 end) * (nx-s.x), s.k) x,
    max_by(s.y + (case when step > 0 then (j.i*j.total/j.c - s.begun)/step else 0 end) * (ny-s.y), s.k) y
  from j join s on s.outline_id = j.outline_id and (s.begun < j.i*j.total/j.c or s.k = 1) group by 1, 2, 3)"""
# Five passes in a row, as they are defined.
SMOOTH = f"{RESAMPLE}" + "".join(
    f", w{i} as (select outline_id, seq, (coalesce(lag(x) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) + 2*x + coalesce(lead(x) over w, first_value(x) over w)) / 4 x,"
    f" (coalesce(lag(y) over w, last_value(y) over (w rows between unbounded preceding and unbounded following)) + 2*y + coalesce(lead(y) over w, first_value(y) over w)) / 4 y"
    f" from {'rs' if i == 1 else f'w{i - 1}'} window w as (partition by outline_id order by seq))"
    for i in range(1, 6)
)
_LAND = """with o as (select vec_id outline_id, generate_subscripts(embedding, 1) - 1 seq, unnest(embedding)::double r from embeddings),
  k as (select outline_id, seq, (2+r)*cos(2*pi()*seq/64) x, (2+r)*sin(2*pi()*seq/64) y from o),
  v as (select *, coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny from k
    window w as (partition by outline_id order by seq))"""
L = f"l as ({t.POLYLINES})"
ARC = f"with {L} select line_id, coalesce(sum(d), 0) arc_length from (select line_id, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) d from l window w as (partition by line_id order by seq)) group by 1"
_B = lambda p, q, a, b: f"({p} * (({b} - s) / ({b} - {a})) + {q} * ((s - {a}) / ({b} - {a})))"


def _catmull(c: str) -> str:
    a1 = f"(case when t1 > 0 then {_B(f'{c}0', f'{c}1', '0', 't1')} else {c}1 end)"
    a2 = _B(f"{c}1", f"{c}2", "t1", "t2")
    a3 = f"(case when t3 > t2 then {_B(f'{c}2', f'{c}3', 't2', 't3')} else {c}2 end)"
    b1, b2 = _B(a1, a2, "0", "t2"), _B(a2, a3, "t1", "t3")
    return _B(b1, b2, "t1", "t2")


CATMULL = f"""with {L}, n as (select *, row_number() over w - 1 k, count(*) over (partition by line_id) m, coalesce(lag(x) over w, x) x0, coalesce(lag(y) over w, y) y0,
    x x1, y y1, lead(x) over w x2, lead(y) over w y2, coalesce(lead(x, 2) over w, lead(x) over w) x3, coalesce(lead(y, 2) over w, lead(y) over w) y3
    from l window w as (partition by line_id order by seq)),
  u as (select *, sqrt({_D(0, 1)}) t1, sqrt({_D(0, 1)}) + sqrt({_D(1, 2)}) t2, sqrt({_D(0, 1)}) + sqrt({_D(1, 2)}) + sqrt({_D(2, 3)}) t3 from n where m >= 3),
  j as (select *, t1 + i/50.0e0*(t2-t1) s from (select *, unnest(range(50)) i from u where x2 is not null)),
  dn as (select line_id, k*50+i i, {_catmull("x")} x, {_catmull("y")} y from j union all select line_id, k*50, x, y from u where x2 is null),
  w as (select *, lag(x) over w px, lag(y) over w py, lead(x) over w nx, lead(y) over w ny from dn window w as (partition by line_id order by i)),
  z as (select *, sqrt((x-px)*(x-px)+(y-py)*(y-py)) l1, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) l2,
    abs(atan2((x-px)*(ny-y)-(y-py)*(nx-x), (x-px)*(nx-x)+(y-py)*(ny-y)))*180/pi() g from w),
  y as (select line_id, sum(l1) arc, sum(case when px is not null and nx is not null then (case when l1 < 1e-10 or l2 < 1e-10 then 0 else g end) end) s,
    avg(case when px is not null and nx is not null then (case when l1 < 1e-10 or l2 < 1e-10 then 0 else g end) end) mean,
    var_pop(case when px is not null and nx is not null then (case when l1 < 1e-10 or l2 < 1e-10 then 0 else g end) end) var,
    sum(case when px is not null and nx is not null and l1 >= 1e-5 and l2 >= 1e-5 then g else 0 end) tl from z group by 1),
  e as (select line_id, count(*) points, sqrt(pow(max_by(x, seq) - min_by(x, seq), 2) + pow(max_by(y, seq) - min_by(y, seq), 2)) chord from l group by 1)
select line_id, points, {ratio("tl", "arc", 2)} turning_per_length, {ratio("arc", "chord", 2)} arc_chord_ratio, {even("s", 4)} sum_turning,
  {even("mean", 4)} mean_turning, {even("var", 4)} var_turning from y join e using (line_id)"""

# Clicks up to a double click are one spline of three points at least.
_CLICKED = f"""select [session_id, op_seq] line_id, row_number() over (partition by session_id, op_seq order by click_seq) - 1 seq, x, y from (
  select *, max(d) over (partition by session_id, op_seq) closed, sum(1 - d) over (partition by session_id, op_seq) m from (
    select *, coalesce(sum(d) over (partition by session_id order by click_seq rows between unbounded preceding and 1 preceding), 0)::bigint op_seq
    from (select *, (event_type = 'signup')::int d from ({t.CLICKS})))) where d = 0 and closed = 1 and m >= 3"""
CLICK_SPLINES = f"select * exclude (line_id), line_id[1] session_id, line_id[2] op_seq from ({CATMULL.replace(L, f'l as ({_CLICKED})')})"
_EFD4 = f"with {NORM}, e4 as (select outline_id, harmonic, round(a, 4) + 0.0 a, round(b, 4) + 0.0 b, round(c, 4) + 0.0 c, round(d, 4) + 0.0 d from norm)"
SUMMARY = f"""{_EFD4}, lines as (select outline_id, string_agg(printf('%d: %.4f %.4f %.4f %.4f', harmonic, a, b, c, d), chr(10) order by harmonic) lines from e4 group by 1)
select outline_id, printf('Perimeter: %.2f\nArea: %.2f\nAspect ratio: %.2f\nPerimeter/area: %.4f\nCircularity: %.4f\nTurning: %.4f, mean %.4f, variance %.4f\n',
  perimeter, area, aspect_ratio, perimeter_area_ratio, circularity, sum_turning, mean_turning, var_turning) || lines report from ({SHAPE}) join lines using (outline_id)"""
# Four digits, the least of them as Java writes them.
_TEXT = lambda c: f"case when {c} <> 0 and abs({c}) < 1e-3 then printf('%d.0E-4', round({c} * 1e4)::bigint) else {c}::varchar end"
CSV = f"""{_EFD4}, nm as ({NAMES}), b as (select outline_id, specimen_name, harmonic, a, b, c, d from e4 join nm on image_id = outline_id)
select distinct outline_id, 0::bigint line_no, case when regexp_matches(specimen_name, '[",\r\n]') then '"' || replace(specimen_name, '"', '""') || '"' else specimen_name end line from b
union all select distinct outline_id, 1, 'harmonic,a,b,c,d' from b
union all select outline_id, max(harmonic) + 2, '' from b group by 1
union all select outline_id, harmonic + 1, concat_ws(',', harmonic, {_TEXT("a")}, {_TEXT("b")}, {_TEXT("c")}, {_TEXT("d")}) from b"""
# Background is spread from the corner squares, and from border pixels near their quadrant's corner colour.
_QUADRANT = lambda s: f"(case when {s}.x < 16 then 0 else 1 end + case when {s}.y < 16 then 0 else 2 end)"
_APART = lambda a, b, k="": f"sqrt(2*({a}.r-{b}.{k}r)*({a}.r-{b}.{k}r) + 4*({a}.g-{b}.{k}g)*({a}.g-{b}.{k}g) + 3*({a}.b-{b}.{k}b)*({a}.b-{b}.{k}b))"
_TONES = f"""{P}, {CORNERS}, th as ({THRESHOLD.replace(f"{P}, {CORNERS}, ", "")}),
  tone as (select image_id, corner, floor(r) r, floor(g) g, floor(b) b from corner),
  e as materialized (select p.image_id, p.x, p.y, tone.corner, {_APART("p", "tone")} away, threshold from p join tone using (image_id) join th using (image_id))"""


def _background(share: str, name: str) -> str:
    return f"""d{name} as (select image_id, x, y, away <= threshold * {share} ok from e where corner = {_QUADRANT("e")}),
  {name}(image_id, x, y) as (select image_id, x, y from d{name} where least(x, 31-x) < 4 and least(y, 31-y) < 4 or ok and (x in (0, 31) or y in (0, 31))
    union select s.image_id, s.x, s.y from {name} r join d{name} s on {_NEAR} where s.ok)"""


BACKGROUND = f"with recursive {_TONES}, {_background('1', 'bg')}"
RELAXED = f"""with recursive {_TONES}, {_background("0.6e0", "bg")},
  wide(image_id, x, y) as (select * from bg union select s.image_id, s.x, s.y from wide r join e s on {_NEAR} where s.corner = {_QUADRANT("r")} and s.away <= s.threshold)
select {XY} from wide"""
FLOOD = f"""{BACKGROUND}, free as (select p.* from p anti join bg using (image_id, x, y)),
  near as (select image_id, sum(r)//count(*) r, sum(g)//count(*) g, sum(b)//count(*) b from free where abs(x-16) <= 2 and abs(y-16) <= 2 group by 1),
  own as (select p.image_id, coalesce(n.r, p.r) r, coalesce(n.g, p.g) g, coalesce(n.b, p.b) b from p left join near n using (image_id) where x = 16 and y = 16),
  k as materialized (select free.*, {_APART("free", "own")} away from free join own using (image_id)),
  fl(image_id, x, y, r, g, b) as (select image_id, x, y, r, g, b from p where x = 16 and y = 16 union
    select s.image_id, s.x, s.y, s.r, s.g, s.b from fl r join k s on {_NEAR} where s.away <= 30 or s.away <= 150 and {_APART("s", "r")} <= 15)
select distinct {XY} from fl"""
PEAK = f"""{BACKGROUND}, z as (select image_id, x, y from bg union select image_id, x, y from p where x in (0, 31) or y in (0, 31)),
  f as (select p.image_id, p.x, p.y, min(abs(p.x-z.x) + abs(p.y-z.y)) d from p anti join bg using (image_id, x, y) join z using (image_id)
    where (p.x-16)*(p.x-16) + (p.y-16)*(p.y-16) <= 225 group by 1, 2, 3),
  top as (select image_id, x, y from f qualify row_number() over (partition by image_id order by d desc, (x = 16 and y = 16) desc, y, x) = 1)
select s_suppkey image_id, coalesce(x, 16)::bigint px, coalesce(y, 16)::bigint py from supplier left join top on image_id = s_suppkey"""
# All dead ends of a list of cells go at once, again and again.
_SIDE = lambda k: f"list_contains(l, c{k})::int"
PRUNED = f"""with recursive {M}, s as (select image_id, list(y*32+x) l from m where inside group by 1),
  r as (select image_id, l, 0 i from s union all select image_id, n, i + 1 from (select *, list_filter(l, lambda c:
    c%32 in (0, 31) or c//32 in (0, 31) or {_SIDE("-1")} + {_SIDE("+1")} + {_SIDE("-32")} + {_SIDE("+32")} >= 2) n from r) where len(n) < len(l)),
  u as (select image_id, unnest(l) c from (select image_id, arg_max(l, i) l from r group by 1))
select image_id, (c%32)::bigint x, (c//32)::bigint y from u"""
CANVAS = f"""select image_id, trunc((x - s_suppkey % 5) / (1 + s_suppkey % 3))::bigint x, trunc((y - s_suppkey % 7) / (1 + s_suppkey % 3))::bigint y
from (select session_id image_id, x, y from ({t.CLICKS})) join supplier on s_suppkey = image_id"""

ROUND_TRIP = f"with {NORM}, nm as ({NAMES}) select specimen_name, harmonic, a, b, c, d from norm join nm on image_id = outline_id"
NEAREST = f"""with o as ({t.OUTLINES}), c as (select session_id * 1000000 + click_seq point_id, session_id outline_id, x/10 - 5 px, y/10 - 5 py from ({t.CLICKS})),
  d as (select point_id, outline_id, seq, sqrt((px-x)*(px-x) + (py-y)*(py-y)) distance from c join o using (outline_id))
select point_id, outline_id, seq, distance from d qualify row_number() over (partition by point_id order by distance, seq) = 1"""
TARGETS = f"""select p_partkey image_id, greatest(1, least(p_size*1000, round_even(p_size*1000 * greatest(0.001e0, least(100, p_retailprice::double/15 - 5)) / 100e0, 0)))::bigint pixels,
  {even("greatest(1, least(p_size*1000, p_partkey*13 - 50)) / (p_size*1000)::double * 100", 2)} percent from part"""
LOCKED = "select event_id, coalesce(try_cast(case when event_id % 3 = 0 then event_type else regexp_extract(props, '([0-9]+)', 1) end as double), 0) angle from events"
CLAMPED = "select c_custkey customer, (case when c_custkey % 5 = 0 then 10 else greatest(1, least(100, c_custkey % 130 - 10)) end)::bigint harmonics from customer"
DIRECTIONS = f"""with n as (select session_id, x, y, (row_number() over (partition by session_id order by click_seq) - 1) k from ({t.CLICKS})),
  p as (select a.session_id, a.k//2 op_seq, a.x x1, a.y y1, b.x - a.x dx, b.y - a.y dy from n a join n b on b.session_id = a.session_id and b.k = a.k + 1 where a.k % 2 = 0),
  l as (select *, sqrt(dx*dx + dy*dy) l from p)
select session_id, op_seq, case when l < 1e-6 then 0 else dx/l end dx, case when l < 1e-6 then 0 else dy/l end dy, {ratio("greatest(abs(dx), abs(dy))", "least(abs(dx), abs(dy))", 2)} aspect from l"""

# Segments (a, b) of a line's list of points, each cut at its farthest point while that is beyond 20.
_ALONG = "greatest(0, least(1, coalesce(((p[k].x-p[a].x)*(p[b].x-p[a].x) + (p[k].y-p[a].y)*(p[b].y-p[a].y)) / nullif((p[b].x-p[a].x)*(p[b].x-p[a].x) + (p[b].y-p[a].y)*(p[b].y-p[a].y), 0), 0)))"
_OFF = f"sqrt(pow(p[k].x - p[a].x - {_ALONG}*(p[b].x-p[a].x), 2) + pow(p[k].y - p[a].y - {_ALONG}*(p[b].y-p[a].y), 2))"
SIMPLIFIED = f"""with recursive {L}, pt as (select line_id, list(struct_pack(x := x, y := y) order by seq) p, list(seq order by seq) s, count(*) n from l group by 1),
  sg(line_id, a, b) as (select line_id, 1::bigint, n from pt union all select line_id, unnest([a, m]), unnest([m, b]) from (
    select line_id, a, b, a + list_position(ds, list_max(ds)) m, list_max(ds) d from (
      select sg.line_id, a, b, list_transform(range(a + 1, b), lambda k: {_OFF}) ds from sg join pt using (line_id) where b > a + 1)) where d > 20),
  kp as (select line_id, a k from sg union select line_id, b from sg)
select line_id, s[k] seq, p[k].x x, p[k].y y from kp join pt using (line_id)"""

ORACLE_SQL: dict[str, str] = {
    "outline_perimeter_area": _rounded(PERIMETER_AREA, "perimeter signed_area area", 6),
    "outline_shape_metrics": _rounded(SHAPE, "perimeter area min_x min_y max_x max_y sum_turning var_turning mean_turning aspect_ratio perimeter_area_ratio circularity", 4),
    "turning_angles": _rounded(f"with {NEXT} select outline_id, seq, {TURN} angle from v", "angle", 6),
    "self_intersects": CROSS,
    "resample": _rounded(f"with {RESAMPLE} select outline_id, seq, x, y from rs", "x y", 6),
    "packed_outlines": _rounded(f"with {O} select outline_id, seq, x, y from o", "x y", 6),
    "landmark_metrics": _rounded(f"{_LAND} select outline_id, count(*) n, sum({LEN}) perimeter, sum(x*ny - y*nx) / 2 signed_area, abs(sum(x*ny - y*nx) / 2) area from v group by 1", "perimeter signed_area area", 6),
    "efd_raw": _rounded(f"with {EFD} select * from raw", "a b c d", 6),
    "efd_normalized": _rounded(f"with {NORM} select * from norm", "a b c d", 6),
    "projection_series": _rounded(f"with {NORM} {SERIES.format(efd='norm')}", "x y", 6),
    "efd_reconstruct": _rounded(f"with {EFD}, q as ({SERIES.format(efd='raw')}), z as (select outline_id, avg(x) mx, avg(y) my from o group by 1) select outline_id, sample, x+mx x, y+my y from q join z using (outline_id)", "x y", 6),
    "circular_arc_metrics": _rounded(ARCS, "central_angle radius chord_rise_ratio chord_arc_ratio", 4),
    "parabola_metrics": _rounded(PARABOLAS, "a rise_span_ratio vertex_curvature chord_arc_ratio", 5),
    "triangle_metrics": _rounded(TRIANGLE, "angle_a angle_b angle_c area relative_area aspect_ratio", 4),
    "shape_metrics": _rounded(SHAPES, "width height area aspect_ratio relative_area", 4),
    "line_metrics": _rounded(LINES, "length angle relative_length", 4),
    "catmull_rom_metrics": _rounded(CATMULL, "turning_per_length arc_chord_ratio sum_turning mean_turning var_turning", 4),
    "arc_length": _rounded(ARC, "arc_length", 6),
    "adjust_pixels": ADJUST,
    "downsample": DOWNSAMPLE,
    "corner_colors": _rounded(f"with {P}, {CORNERS} select image_id, corner::bigint corner, r, g, b from corner", "r g b", 6),
    "adaptive_threshold": _rounded(THRESHOLD, "threshold", 6),
    "box_blur": BLUR,
    "sobel": SOBEL,
    "distance_transform": DISTANCE,
    "constrained_line_metrics": _rounded(CONSTRAINED, "length angle relative_length", 4),
    "open_close": OPEN_CLOSE,
    "smooth_topology": TOPOLOGY,
    "erode": ERODE,
    "dilate": DILATE,
    "corridor": CORRIDOR,
    "mask_bounds": BOUNDS,
    "strip_border": f"with {M} select {XY} from m where inside and x between 5 and 26 and y between 5 and 26",
    "rasterize": RASTER,
    "specimen_names": NAMES,
    "components": f"{COMPONENTS} select image_id, cy::bigint cy, cx::bigint cx, n from n",
    "largest_component": f"{COMPONENTS} select image_id, max(n) area from n group by 1",
    "fill_holes": HOLES,
    "trace_boundary": TRACE,
    "convex_hull": _rounded(HULL_POINTS, "x y", 6),
    "solidity": _rounded(SOLIDITY, "hull_area solidity", 4),
    "smooth_outline": _rounded(f"with {SMOOTH} select outline_id, seq, x, y from w5", "x y", 6),
    "seed_color": SEED,
    "click_spline_metrics": _rounded(CLICK_SPLINES, "turning_per_length arc_chord_ratio sum_turning mean_turning var_turning", 4),
    "metadata_summary": SUMMARY,
    "efd_csv_lines": CSV,
    "replay_history": f"with recursive {REPLAYED} select * from rp",
    "latest_result": _rounded(LATEST, "measure relative", 4),
    "background_mask": f"{BACKGROUND} select {XY} from bg",
    "background_mask_relaxed": RELAXED,
    "flood_fill": FLOOD,
    "interior_peak": PEAK,
    "prune_dead_ends": PRUNED,
    "read_images": f"with {P} select {XY}, r::bigint r, g::bigint g, b::bigint b from p",
    "efd_csv_round_trip": _rounded(ROUND_TRIP, "a b c d", 6),
    "nearest_vertex": _rounded(NEAREST, "distance", 6),
    "target_pixels": _rounded(TARGETS, "percent", 6),
    "locked_angle": _rounded(LOCKED, "angle", 6),
    "harmonic_clamp": CLAMPED,
    "line_direction": _rounded(DIRECTIONS, "dx dy aspect", 6),
    "simplify": _rounded(SIMPLIFIED, "x y", 6),
    "carve": CARVED,
    "image_to_pixel": f"select * from ({CANVAS}) where x between 0 and 319 and y between 0 and 319",
}
