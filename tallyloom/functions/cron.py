"""Cron slots as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower and upper bounds of second, minute, hour, day of month, month, day of week (fixed values; Sunday is 0, and 7).
BOUNDS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Days after which any spec that has a day at all has had one: eight years, for 29 February beside a century's end; with a day of the week, the calendar's 28 years and a century's end.
DAYS, WEEK_DAYS = 8 * 366, 40 * 366


def _field(text: str, low: int, high: int) -> list[int]:
    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        begin, end = (low, high) if span == "*" else (int(first), int(last or (high if step else first)))
        if not low <= begin <= end <= high or step and int(step) < 1:
            raise ValueError(f"cron field {text!r} is outside {low}-{high}")
        found.update(range(begin, end + 1, int(step or 1)))
    return sorted(found)


def parse(spec: str) -> list[list[int]]:
    """The values of the six fields; five fields mean second 0."""
    fields = spec.split()
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError(f"cron spec {spec!r} needs five or six fields")
    return [_field(x, *b) for x, b in zip(fields, BOUNDS, strict=True)]


def _latest(values: list[int], upto: Column) -> Column:
    """The largest of a field's values up to a number, null if there is none: one look-up."""
    table = [max((v for v in values if v <= n), default=None) for n in range(max(values) + 1)]
    return F.get(F.array(*[F.lit(x).cast("int") for x in table]), F.least(upto, F.lit(max(values))))


def previous_slot(spec: str, at: Column, days: int | None = None) -> Column:
    """The latest slot at or before ``at`` (TIMESTAMP_NTZ), null if none lies within ``days`` days, or without it ever.

    On the day of ``at`` the latest time is found field by field, hour, then minute, then
    second; on earlier days it is the last of each. Where day of month or day of week is
    limited, days are tried backwards until the first that fits. Both apply, by either where
    both are limited.
    """
    seconds, minutes, hours, month_days, months, week_days = parse(spec)
    week = sorted({d % 7 for d in week_days})
    any_day = len(month_days) == 31 and len(week) == 7 and len(months) == 12
    if days is None:
        days = 1 if any_day else WEEK_DAYS if len(week) < 7 and len(month_days) < 31 else DAYS

    def fits(day: Column) -> Column:
        if any_day:
            return day.isNotNull()
        dom, dow = F.dayofmonth(day).isin(month_days), (F.dayofweek(day) - 1).isin(week)
        return F.month(day).isin(months) & (dom | dow if len(month_days) < 31 and len(week) < 7 else dom & dow)

    def slot(day: Column, second: Column) -> Column:
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)

    h, m, s = F.hour(at), F.minute(at), F.second(at)
    last_m, last_s = max(minutes), max(seconds)
    in_minute, in_hour = _latest(seconds, s), _latest(minutes, m - 1)
    within = F.when(h.isin(hours) & m.isin(minutes) & in_minute.isNotNull(), h * 3600 + m * 60 + in_minute).when(h.isin(hours) & in_hour.isNotNull(), h * 3600 + in_hour * 60 + last_s)
    started = F.coalesce(within, _latest(hours, h - 1) * 3600 + last_m * 60 + last_s)
    today, last = F.to_date(at), F.lit(max(hours) * 3600 + last_m * 60 + last_s)
    same_day = F.when(fits(today) & started.isNotNull(), slot(today, started))
    if any_day:
        return F.coalesce(same_day, slot(F.date_sub(today, 1), last))
    near = min(days, 31)
    step = lambda d: F.when(fits(F.date_sub(today, d)), d)
    back = F.coalesce(*[step(F.lit(d)) for d in range(1, min(8, days + 1))])
    if days > 7:  # beyond a week few rows have to look
        back = F.coalesce(back, F.get(F.filter(F.sequence(F.lit(8), F.lit(max(8, near))), lambda d: fits(F.date_sub(today, d))), F.lit(0)))
    if days > 31:
        back = F.coalesce(back, F.get(F.filter(F.sequence(F.lit(32), F.lit(days)), lambda d: fits(F.date_sub(today, d))), F.lit(0)))
    return F.coalesce(same_day, F.when(back.isNotNull() & (back <= days), slot(F.date_sub(today, back), last)))


def due_slot(spec: str, now: Column, active_since: Column, last_fired: Column) -> Column:
    """The slot a schedule fires now: the latest one, not before it became active nor at or before the last one fired; slots missed are not made up for."""
    slot = previous_slot(spec, now)
    return F.when((slot >= active_since) & (last_fired.isNull() | (slot > last_fired)), slot)
