"""Column functions: half-width view, hashes, generalisers, intervals. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the half-width view translates, one character to one.
FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ－．／：％＠＿＝￥　"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-./:%@_=¥ "

# Bands of amounts in yuan (upper bounds), municipalities, and cities with their provinces.
AMOUNT_BANDS = ((1e6, "100万元以下"), (1e7, "100万–1000万元"), (1e8, "1000万–1亿元"), (1e9, "1亿–10亿元"), (1e10, "10亿–100亿元"))
AMOUNT_TOP = "100亿元以上"
MUNICIPALITIES = ("北京", "上海", "天津", "重庆")
AUTONOMOUS = "(内蒙古|广西壮族|西藏|宁夏回族|新疆维吾尔)自治区"
PROVINCE = "([一-龥]{2,3})省"
CITIES = {
    "济南": "山东省", "青岛": "山东省", "烟台": "山东省", "广州": "广东省", "深圳": "广东省", "东莞": "广东省", "杭州": "浙江省", "宁波": "浙江省",
    "南京": "江苏省", "苏州": "江苏省", "无锡": "江苏省", "成都": "四川省", "武汉": "湖北省", "长沙": "湖南省", "西安": "陕西省", "郑州": "河南省",
    "合肥": "安徽省", "福州": "福建省", "厦门": "福建省", "南昌": "江西省", "石家庄": "河北省", "太原": "山西省", "沈阳": "辽宁省", "大连": "辽宁省",
    "长春": "吉林省", "哈尔滨": "黑龙江省", "昆明": "云南省", "贵阳": "贵州省", "南宁": "广西壮族自治区", "兰州": "甘肃省", "乌鲁木齐": "新疆维吾尔自治区",
}
SOMEWHERE = "某地区"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_width(text: Column | str) -> Column:
    """Full-width digits, letters and value punctuation as half-width ones; offsets stay."""
    return F.translate(_col(text), FULL, HALF)


def text_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(_col(text), "UTF-8"), 256))


def keyed_hash(text: Column | str, key: bytes) -> Column:
    """The first 16 hex digits of HMAC-SHA256, from two rounds of the plain hash."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(_col(text), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 16)


def amount_yuan(value: Column | str) -> Column:
    """The first number of an amount, in yuan; null without one."""
    cleaned = F.regexp_replace(_col(value), "人民币|[￥¥ ]", "")
    pattern = r"(\d[\d,，]*(?:\.\d+)?)\s*(亿|万)?"
    number = F.regexp_replace(F.regexp_extract(cleaned, pattern, 1), "[,，]", "")
    unit = F.regexp_extract(cleaned, pattern, 2)
    scale = F.when(unit == "亿", 1e8).when(unit == "万", 1e4).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * scale)


def amount_bucket(value: Column | str) -> Column:
    yuan = amount_yuan(value)
    out = F.when(yuan.isNull(), F.lit(None).cast("string"))
    for bound, name in AMOUNT_BANDS:
        out = out.when(yuan < bound, name)
    return out.otherwise(AMOUNT_TOP)


def amount_band(value: Column | str) -> Column:
    """Bands of ten times a hundred million."""
    yi = amount_yuan(value) / 1e8
    low = (F.floor(yi / 10) * 10).cast("int")
    return F.when(yi.isNull(), F.lit(None).cast("string")).when(yi < 10, "10亿元以下").when(yi >= 100, AMOUNT_TOP).otherwise(F.format_string("%d亿–%d亿元", low, low + 10))


def region(value: Column | str) -> Column:
    """Municipality, autonomous region, province, province of a known city, or "somewhere", in this order."""
    v = _col(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for m in MUNICIPALITIES:
        out = out.when(v.contains(m), f"{m}市")
    for pattern in (AUTONOMOUS, PROVINCE):
        out = out.when(v.rlike(pattern), F.regexp_extract(v, pattern, 0))
    for city, province in CITIES.items():
        out = out.when(v.contains(city), province)
    return out.otherwise(SOMEWHERE)


def quarter(value: Column | str) -> Column:
    pattern = r"(\d{4})\D{0,2}(\d{1,2})"
    year, month = (F.regexp_extract(_col(value), pattern, g) for g in (1, 2))
    m = month.try_cast("int")
    return F.when((year != "") & m.between(1, 12), F.concat(year.cast("int").cast("string"), F.lit("年Q"), (F.floor((m - 1) / 3) + 1).cast("string")))


GENERALIZERS = {"amount_bucket": amount_bucket, "amount_band_10yi": amount_band, "region": region, "quarter": quarter}


def register_generalizer(name: str, f: Callable[[Column], Column]) -> None:
    """Profiles may name f from now on: it makes a coarse value of a half-width one, or null where it can't."""
    if name in GENERALIZERS:
        raise ValueError(f"generalizer {name} is registered already")
    GENERALIZERS[name] = f


def generalize(name: Column | str, value: Column | str) -> Column:
    """The coarse value by a generaliser's name; null for other names, for which callers use a placeholder."""
    seen, out = half_width(value), F.when(F.lit(False), F.lit(None).cast("string"))
    for key, f in GENERALIZERS.items():
        out = out.when(_col(name) == key, f(seen))
    return out.otherwise(F.lit(None).cast("string"))


def wilson(hits: Column | str, total: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a rate; (0, 0) for no cases."""
    k, n = _col(hits).cast("double"), _col(total).cast("double")
    p = k / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def entropy(text: Column | str) -> Column:
    """Shannon entropy of the characters, in bits."""
    t = _col(text)
    chars = F.split(t, "")
    n = F.char_length(t).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, -F.aggregate(each, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)
