"""One query for each scalar builder, over all rows of a view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geo as g
from .functions import stamps as st
from .registry import query, scalar

A = F.col
PI = "pi()"
WRAP = "(({0}) + pi() - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"
W = WRAP.format


def named(names: str, columns) -> dict:
    return dict(zip(names.split(), columns))


scalar("azalt_to_dir", "v_pose", "seq", lambda: named("x y z", g.azalt_to_dir("az", "alt")), {"x": "cos(az)*cos(alt)", "y": "sin(az)*cos(alt)", "z": "sin(alt)"})
scalar("dir_to_azalt", "v_dirs", "id", lambda: named("az alt", g.dir_to_azalt(g.v3())), {"az": "atan2(y, x)", "alt": "atan2(z, sqrt(x*x+y*y))"})
scalar("enu_from_altaz", "v_pose", "seq", lambda: named("x y z", g.enu_from_altaz("az", "alt")), {"x": "cos(alt)*sin(az)", "y": "cos(alt)*cos(az)", "z": "sin(alt)"})
scalar("wrap_pi", "v_pose", "seq", lambda: {"a": g.wrap_pi(A("az") * 3 - 4)}, {"a": W("az*3 - 4")})
scalar("lerp", "v_pose", "seq", lambda: {"v": g.lerp("az", "alt", A("k") / 99)}, {"v": "az + (alt - az)*(k/99e0)"})
scalar("normalize", "v_dirs", "id", lambda: named("nx ny nz", g.normalize((A("x") * 3, A("y") * 2, A("z")))), {f"n{a}": f"{e}/greatest(sqrt(9*x*x+4*y*y+z*z), 1e-12)" for a, e in (("x", "3*x"), ("y", "2*y"), ("z", "z"))})
scalar("angle_between", "v_dirs", "id", lambda: {"full": g.angle_between(g.v3(), (A("y"), A("z"), A("x"))), "residual": g.residual_angle(g.v3(), (A("y"), A("z"), A("x")))}, {"full": "acos(greatest(-1, least(1, x*y+y*z+z*x)))", "residual": "asin(least(1, sqrt(pow(y*x-z*z,2)+pow(z*y-x*x,2)+pow(x*z-y*y,2))))"})
scalar("rodrigues", "v_dirs", "id", lambda: named("rx ry rz", g.rodrigues((A("y"), A("z"), A("x")), g.v3(), F.lit(0.7))), {f"r{n}": f"{v}*cos(0.7e0) + ({k})*sin(0.7e0) + {a}*(x*y+y*z+z*x)*(1-cos(0.7e0))" for n, v, k, a in (("x", "y", "y*x-z*z", "x"), ("y", "z", "z*y-x*x", "y"), ("z", "x", "x*z-y*y", "z"))})
scalar("image_axes", "v_dirs", "id", lambda: named("lx ly lz ux uy uz", [c for v in g.image_axes(g.v3()) for c in v]), {"lx": "-y/sqrt(x*x+y*y)", "ly": "x/sqrt(x*x+y*y)", "lz": "0e0", "ux": "-z*x/sqrt(x*x+y*y)", "uy": "-z*y/sqrt(x*x+y*y)", "uz": "(x*x+y*y)/sqrt(x*x+y*y)"})
scalar("altaz_rates", "v_pose", "seq", lambda: named("raz ralt", g.altaz_rates("az", "alt", A("alt") * 5, A("az") / 3, F.lit(2.0))), {"raz": W("alt*5 - az") + "/2", "ralt": W("az/3 - alt") + "/2"})
scalar("dir_rates", "v_dirs", "id", lambda: named("dx dy dz", g.dir_rates(g.v3(), (A("y"), A("z"), A("x")), F.lit(0.5))), {"dx": "(y-x)/0.5e0", "dy": "(z-y)/0.5e0", "dz": "(x-z)/0.5e0"})
DET = {"f": ("cos(az)*cos(alt)", "sin(az)*cos(alt)", "sin(alt)"), "s": ("-sin(az)", "cos(az)", "0e0"), "u": ("-cos(az)*sin(alt)", "-sin(az)*sin(alt)", "cos(alt)")}
OX, OY = "((k*38e0-1920)*1e-4)", "(-(k*21e0-1080)*1e-4)"
RAY = [f"({f} + ({s})*{OX} + ({u})*{OY})" for f, s, u in zip(DET["f"], DET["s"], DET["u"])]
LEN = f"sqrt({RAY[0]}*{RAY[0]}+{RAY[1]}*{RAY[1]}+{RAY[2]}*{RAY[2]})"
scalar("pixel_to_dir", "v_pose", "seq", lambda: named("x y z", g.pixel_to_dir(A("k") * 38.0, A("k") * 21.0, "az", "alt", 1920.0, 1080.0, 1e-4)), {n: f"{e}/{LEN}" for n, e in zip("xyz", RAY)})
scalar("dir_to_pixel", "v_pose", "seq", lambda: named("px py", g.dir_to_pixel(g.pixel_to_dir(A("k") * 38.0, A("k") * 21.0, "az", "alt", 1920.0, 1080.0, 1e-4), "az", "alt", 1920.0, 1080.0, 1e-4)), {"px": "k*38e0", "py": "k*21e0"})
scalar("boresight_basis", "v_pose", "seq", lambda: named("bx by bz ax ay az2 ux uy uz", [c for v in g.boresight_basis("az", "alt", 0.1, -0.05) for c in v]), {"bx": "cos(alt-0.05e0)*sin(az+0.1e0)", "by": "cos(alt-0.05e0)*cos(az+0.1e0)", "bz": "sin(alt-0.05e0)", "ax": "cos(az+0.1e0)", "ay": "-sin(az+0.1e0)", "az2": "0e0", "ux": "-sin(alt-0.05e0)*sin(az+0.1e0)", "uy": "-sin(alt-0.05e0)*cos(az+0.1e0)", "uz": "cos(alt-0.05e0)"})


@query("project_sources", "v_dirs", sql="SELECT id, y > 0 AS visible, (round(CASE WHEN y > 0.01e0 THEN 256 + 900*(x/y*cos(0.3e0) + z/y*sin(0.3e0)) END, 6) + 0e0) AS px, (round(CASE WHEN y > 0.01e0 THEN 256 - 900*(-x/y*sin(0.3e0) + z/y*cos(0.3e0)) END, 6) + 0e0) AS py FROM v_dirs")
def project_sources(dirs):
    b, right, up = g.boresight_basis(F.lit(0.0), F.lit(0.0))
    px, py, visible = g.project_sources(g.v3(), b, right, up, 900.0, 256.0, 256.0, 0.3)
    near = A("y") > 0.01
    return dirs.select("id", visible.alias("visible"), (F.round(F.when(near, px), 6) + 0.0).alias("px"), (F.round(F.when(near, py), 6) + 0.0).alias("py"))


FOC = "(tan(radians(50e0)/2)/tan(radians(5e0)/2))"
scalar("cross_camera_pixel", "v_blobs", "frame, blob, k1, k2", lambda: named("qx qy", g.cross_camera_pixel("px", "py", 3840.0, 2160.0, 50.0, 1920.0, 1080.0, 5.0)), {"qx": f"960 + (px - 1920)*0.5e0*{FOC}", "qy": f"540 + (py - 1080)*0.5e0*{FOC}"})
E2 = "(1/298.257223563e0*(2-1/298.257223563e0))"
NN = f"(6378137e0/sqrt(1-{E2}*pow(sin(radians(lat_deg)),2)))"
ECEF = (f"(({NN}+h_m)*cos(radians(lat_deg))*cos(radians(lon_deg)))", f"(({NN}+h_m)*cos(radians(lat_deg))*sin(radians(lon_deg)))", f"(({NN}*(1-{E2})+h_m)*sin(radians(lat_deg)))")
HOME = (4000000.0, 800000.0, 4900000.0)
scalar("geodetic_to_ecef", "v_fixes", "seq", lambda: named("x y z", [c / 1000 for c in g.geodetic_to_ecef("lat_deg", "lon_deg", "h_m")]), {n: f"{e}/1000" for n, e in zip("xyz", ECEF)})


def altaz_sql(home: str, east: tuple, north: tuple, up: tuple) -> str:
    d = [f"({e}-{h})" for e, h in zip(("x", "y", "z"), home.split())]
    e, n, u = (" + ".join(f"{a}*({b})" for a, b in zip(d, v)) for v in (east, north, up))
    return f"SELECT seq, (round(atan2({e}, {n}), 6) + 0e0) AS az, (round(atan2({u}, sqrt(pow({e}, 2) + pow({n}, 2))), 6) + 0e0) AS alt, (round(sqrt({'+'.join(f'{a}*{a}' for a in d)})/1000, 6) + 0e0) AS dist_km FROM (SELECT seq, {', '.join(f'{q} AS {k}' for k, q in zip('xyz', ECEF))} FROM v_fixes) q"


_h = sum(x * x for x in HOME) ** 0.5
_u = [x / _h for x in HOME]
_n = (HOME[0] ** 2 + HOME[1] ** 2) ** 0.5
_e = [-HOME[1] / _n, HOME[0] / _n, 0.0]
_m = [_u[1] * _e[2] - _u[2] * _e[1], _u[2] * _e[0] - _u[0] * _e[2], _u[0] * _e[1] - _u[1] * _e[0]]
num = lambda v: tuple(f"{x!r}::DOUBLE" for x in v)


@query("ecef_to_altaz_direct", "v_fixes", sql=altaz_sql(" ".join(num(HOME)), num(_e), num(_m), num(_u)))
def ecef_to_altaz_direct(fixes):
    az, alt, dist = g.ecef_to_altaz_direct(g.geodetic_to_ecef("lat_deg", "lon_deg", "h_m"), tuple(F.lit(x) for x in HOME))
    return fixes.select("seq", (F.round(az, 6) + 0.0).alias("az"), (F.round(alt, 6) + 0.0).alias("alt"), (F.round(dist / 1000, 6) + 0.0).alias("dist_km"))


def _site_ecef(lat, lon, h):
    import math

    la, lo = math.radians(lat), math.radians(lon)
    e2 = g.EARTH_F * (2 - g.EARTH_F)
    n = g.EARTH_A / math.sqrt(1 - e2 * math.sin(la) ** 2)
    place = ((n + h) * math.cos(la) * math.cos(lo), (n + h) * math.cos(la) * math.sin(lo), (n * (1 - e2) + h) * math.sin(la))
    return place, (-math.sin(lo), math.cos(lo), 0.0), (-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)), (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))


_p, *_axes = _site_ecef(48.0, 11.0, 500.0)


@query("ecef_to_altaz_geodetic", "v_fixes", sql=altaz_sql(" ".join(num(_p)), *[num(a) for a in _axes]))
def ecef_to_altaz_geodetic(fixes):
    az, alt, dist = g.ecef_to_altaz_geodetic(g.geodetic_to_ecef("lat_deg", "lon_deg", "h_m"), F.lit(48.0), F.lit(11.0), F.lit(500.0))
    return fixes.select("seq", (F.round(az, 6) + 0.0).alias("az"), (F.round(alt, 6) + 0.0).alias("alt"), (F.round(dist / 1000, 6) + 0.0).alias("dist_km"))


scalar("extrapolate_ecef", "v_fixes", "seq", lambda: named("x y z", g.extrapolate_ecef((A("h_m"), A("lat_deg"), A("lon_deg")), (A("lat_deg"), F.lit(None).cast("double"), A("h_m")), (F.lit(2.0), F.lit(2.0), F.lit(None).cast("double")), F.lit(3.0))), {"x": "h_m + lat_deg*3 + 9", "y": "lat_deg + 9", "z": "lon_deg + h_m*3"})
DEG = "degrees(alt - 0.05e0)"
REFRACT = f"radians(CASE WHEN {DEG} > -1 AND {DEG} <= 89.9e0 THEN {DEG} - 1.02e0*0.016667e0/tan(radians({DEG} + 7.31e0/({DEG} + 4.4e0))) ELSE {DEG} END)"
scalar("refract_true", "v_pose", "seq", lambda: {"alt2": g.refract_true(A("alt") - 0.05, 1.02)}, {"alt2": REFRACT})
#: Without tilt the model is a plain sum; pitch turns about the y axis.
MX, MY, MZ = "cos(alt-0.02e0)*cos(az-0.1e0)", "cos(alt-0.02e0)*sin(az-0.1e0)", "sin(alt-0.02e0)"
scalar("mount_dir", "v_pose", "seq", lambda: named("x y z", g.mount_dir("az", "alt", 0.1, 0.02, 0.0, 0.3)), {"x": f"{MX}*cos(0.3e0) + {MZ}*sin(0.3e0)", "y": MY, "z": f"{MZ}*cos(0.3e0) - {MX}*sin(0.3e0)"})
scalar("mount_raw", "v_pose", "seq", lambda: named("raw0 raw1", g.mount_raw(g.mount_dir("az", A("alt") * 0.9, 0.1, 0.02, 0.05, 0.03, 0.002, 0.001), 0.1, 0.02, 0.05, 0.03, 0.002, 0.001)), {"raw0": W("az"), "raw1": "alt*0.9e0"})
scalar("control_rate", "v_pose", "seq", lambda: {"rate": g.control_rate("az", 0.01, 0.02, "alt", 0.5, 2.0)}, {"rate": "0.01e0 + atan2(sin(az-(alt+0.01e0)), cos(az-(alt+0.01e0)))*2"})
scalar("arcsec_per_px", "v_optics", "optic", lambda: {"scale": g.arcsec_per_px(3.76, "focal_mm", 2)}, {"scale": "206264.8e0*3.76e0*2/1000/focal_mm"})
scalar("rad_per_px", "v_optics", "optic", lambda: {"scale": 1000 * g.rad_per_px(3.76, "focal_mm")}, {"scale": "3.76e0/focal_mm"})
scalar("fov_deg", "v_optics", "optic", lambda: {"fov": g.fov_deg(3840, 2.9, "focal_mm")}, {"fov": "degrees(2*atan(3840*2.9e0/1000/(2*focal_mm)))"})


@query("eyepiece_optics", "v_optics", sql="SELECT optic, (round(focal_mm*2/aperture_mm, 6) + 0e0) AS f_number, (round(focal_mm*2/25, 6) + 0e0) AS zoom, (round(degrees(2*atan(tan(radians(30e0))/(focal_mm*2/25))), 6) + 0e0) AS true_fov_deg, (round(degrees(2*atan(11e0/(4*focal_mm))), 6) + 0e0) AS camera_fov_deg FROM v_optics")
def eyepiece_optics(optics):
    o = g.eyepiece_optics("focal_mm", 2.0, "aperture_mm", 25.0, 60.0, 11.0)
    return optics.withColumn("o", o).select("optic", *[(F.round(A(f"o.{n}"), 6) + 0.0).alias(n) for n in ("f_number", "zoom", "true_fov_deg", "camera_fov_deg")])


scalar("mag_to_flux", "v_stars", "hip", lambda: {"flux": g.mag_to_flux("mag", 1000.0, 0.5)}, {"flux": "500*pow(10e0, -0.4e0*mag)"})
scalar("split_magnitude", "v_stars", "hip", lambda: {"each": g.split_magnitude("mag", A("hip") % 5 + 1)}, {"each": "mag + 2.5e0*log10(hip % 5 + 1)"})
SPIRAL = "(sqrt(2/(2*pi())*0.3e0*k)*2*pi())"
scalar("spiral_offset", "v_pose", "seq", lambda: named("dx dy", g.spiral_offset("k", 0.3, 2.0, 1.5)), {"dx": f"{SPIRAL}/(2*pi())*cos({SPIRAL})*2", "dy": f"{SPIRAL}/(2*pi())*sin({SPIRAL})*1.5e0"})
#: With the mount level and at the pole both axes are those of the sky: the first turns at the sidereal rate.
@query("sidereal_rates", "v_pose", sql="SELECT seq, (round(-2*pi()/86164.0905e0*1e4, 6) + 0e0) AS r0, 0e0 AS r1 FROM v_pose")
def sidereal_rates(pose):
    out = g.with_sidereal_rates(pose.withColumn("alt", A("alt") * 0.9), "az", "alt", 0.0, 0.0, 0.0, 0.0, 90.0)
    return out.select("seq", (F.round(A("rate0") * 1e4, 6) + 0.0).alias("r0"), (F.round(A("rate1") * 1e4, 6) + 0.0).alias("r1"))


scalar("srgb_encode", "v_pixels", "role, idx, y, x", lambda: {"s": g.srgb_encode(A("v") / 65535)}, {"s": "CASE WHEN v/65535e0 <= 0.04045e0/12.92e0 THEN 12.92e0*(v/65535e0) ELSE 1.055e0*pow(v/65535e0, 1/2.4e0)-0.055e0 END"})
scalar("gamma_encode", "v_pixels", "role, idx, y, x", lambda: {"s": g.gamma_encode("v", 65535.0, 4.0, 2.2)}, {"s": "pow(greatest(0, least(1, v*4/65535e0)), 1/2.2e0)"})
scalar("full_scale", "v_stars", "hip", lambda: {"fs": g.full_scale(A("hip") % 16 + 1, A("hip") % 12).cast("double")}, {"fs": "CAST(CASE WHEN hip % 16 + 1 <= 8 THEN 255 ELSE 65535 END * CASE WHEN hip % 12 BETWEEN 8 AND 11 THEN 4 ELSE 1 END AS DOUBLE)"})


@query("ser_ticks", "v_pose", sql="SELECT seq, (t_us + 62135596800000000) * 10 AS ticks, t_us AS back_us FROM v_pose")
def ser_ticks(pose):
    return pose.withColumn("ticks", st.to_ser_ticks("t_us")).select("seq", "ticks", st.from_ser_ticks("ticks").alias("back_us"))


@query("segment_stamp", "v_pose", sql="SELECT seq, strftime(make_timestamp(t_us), '%Y%m%dT%H%M%S%gZ') AS stamp FROM v_pose")
def segment_stamp(pose):
    return pose.select("seq", st.segment_stamp(F.timestamp_micros("t_us")).alias("stamp"))


@query("utc_stamp", "v_pose", sql="SELECT seq, strftime(make_timestamp(t_us), '%Y%m%dT%H%M%SZ') AS stamp FROM v_pose")
def utc_stamp(pose):
    return pose.select("seq", st.utc_stamp(F.timestamp_micros("t_us")).alias("stamp"))


@query("utc_iso", "v_pose", sql="SELECT seq, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM v_pose")
def utc_iso(pose):
    return pose.select("seq", st.utc_iso(F.timestamp_micros("t_us")).alias("stamp"))


scalar("offset_seconds", "v_pose", "seq", lambda: {"s": st.offset_seconds(A("k") % 3, A("k") % 24, "k", A("k") / 2)}, {"s": "(((k % 3)*24 + k % 24)*60 + k)*60 + k/2e0"})


@query("parse_angle", "v_pose", sql="SELECT seq, CASE WHEN k % 3 = 0 THEN (round(k/4e0, 6)+0e0) WHEN k % 3 = 1 THEN (round(-(k + 7/60e0 + 12/3600e0), 6)+0e0) END AS deg FROM v_pose")
def parse_angle(pose):
    text = F.when(A("k") % 3 == 0, (A("k") / 4).cast("string")).when(A("k") % 3 == 1, F.concat(F.lit("-"), A("k").cast("string"), F.lit(":07:12"))).otherwise(F.lit("north"))
    return pose.select("seq", (F.round(st.parse_angle(text), 6) + 0.0).alias("deg"))


@query("target_url", "v_stars", sql="SELECT hip, 'sky://stars/hip_' || CAST(hip AS VARCHAR) AS url FROM v_stars")
def target_url(stars):
    return stars.select("hip", st.target_url("stars", F.concat(F.lit("hip_"), A("hip").cast("string"))).alias("url"))
