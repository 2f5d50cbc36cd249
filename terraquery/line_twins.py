"""SQL twins of the line parser: the same rules in the words of another engine."""

from __future__ import annotations

from terraquery.sources.lines import TIME_SHAPE, LineSpec

_TRIM = r"regexp_replace({},'^[\x00-\x20]+|[\x00-\x20]+$','','g')"
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_WHOLE = "try_cast({0} as double) is not null and abs(try_cast({0} as double)) < 9.2e18 and try_cast({0} as double) = floor(try_cast({0} as double))"


def _value(x: str) -> str:
    """A field without outer blanks and, if it is quoted, without its quotes."""
    t = _TRIM.format(x)
    inner = _TRIM.format(f"""replace(regexp_replace(substr({t},2),'"$',''),'""','"')""")
    return f"""case when {t} like '"%' then {inner} else {t} end"""


def checked(name: str, spec: LineSpec) -> str:
    """Tables up to ``{name}_e``: line_id, the fields f, and the errors of each line that loads or fails."""
    quoted = {True: r'[ ]*"[^"]*(?:""[^"]*)*"[ ]*', False: r'[ \t]*"[^"]*(?:""[^"]*)*"[ \t]*'}
    mark = {True: r"\t", False: ","}
    field = {k: f'(?:{quoted[k]}|[^"{mark[k]}]*)' for k in mark}

    def pick(made) -> str:
        return f"case when tab then {made(True)} else {made(False)} end"

    sound = pick(lambda k: f"regexp_full_match(led,'(?:{mark[k]}{field[k]})+')")
    raws = pick(lambda k: f"regexp_extract_all(led,'{mark[k]}({field[k]})',1)")
    head = pick(lambda k: f"regexp_extract(led,'^{mark[k]}({field[k]})(?:{mark[k]}|$)',1)")
    at = {f: f"f[{i + 1}]" for i, f in enumerate(spec.fields)}
    bad = [
        "case when not sound then 'quoting' when not complete then 'columns' end",
        "case when complete and f[1]='' then 'value:sim_id' end",
        f"case when complete and (not regexp_matches(f[2],'{TIME_SHAPE}') or f[2][18:19] > '59' or try_strptime(f[2],'%Y-%m-%dT%H:%M:%S') is null) then 'value:time_iso' end",
        *[f"case when complete and not regexp_full_match({at[f]},'{_NUMBER}') then 'value:{f}' end" for f in spec.numbers]]
    last = "coalesce(list_max(list_transform(range(1,len(v)+1), lambda i: case when v[i]<>'' then i else 0 end)),0)"
    return f"""{name}_t as (select file_name, bool_or(contains(raw_line,chr(9))) tab from {name} where line_no=1 group by 1),
 {name}_l as (select line_id, coalesce(tab,false) tab, case when coalesce(tab,false) then chr(9) else ',' end
   ||regexp_replace(case when line_no=1 and starts_with(raw_line,chr(65279)) then substr(raw_line,2) else raw_line end,'[\\r\\n]+$','') led
  from {name} left join {name}_t using (file_name) where raw_line is not null),
 {name}_s as (select line_id, {sound} sound, list_transform({raws}, lambda x: {_value("x")}) v from {name}_l where {_TRIM.format("substr(led,2)")}<>'' and {_value(head)}<>'sim_id'),
 {name}_f as (select line_id, sound, v[1:{last}] f from {name}_s),
 {name}_c as (select *, sound and len(f)={len(spec.fields)} complete from {name}_f),
 {name}_e as (select *, list_filter([{", ".join(bad)}], lambda e: e is not null) errors from {name}_c)"""


def failed(tables: dict[str, LineSpec], columns: str) -> str:
    """The failing lines of several tables; ``errors`` is a list."""
    each = " union all ".join(f"select '{n}' table_name, line_id, errors from {n}_e where len(errors)>0" for n in tables)
    return f"with {', '.join(checked(n, s) for n, s in tables.items())} select {columns} from ({each})"


def typed(name: str, spec: LineSpec) -> str:
    """The valid rows of a table."""
    at = {f: f"f[{i + 1}]" for i, f in enumerate(spec.fields)}
    sim = rf"regexp_replace({at['sim_id']},'^([0-9]+)\.0+$','\1')"
    if spec.voxel:
        a, b = (_TRIM.format(f"split_part({at['sim_id']},'/',{i})") for i in (1, 2))
        side = [f"case when regexp_full_match({t},'{_NUMBER}') and {_WHOLE.format(t)} then try_cast({t} as double)::bigint::varchar else {t} end" for t in (a, b)]
        sim = f"case when regexp_full_match({at['sim_id']},'[^/]*/[^/]+/*') then {side[0]}||'/'||{side[1]} else {at['sim_id']} end"
    numbers = ", ".join(f"{at[f]}::double {f}" for f in spec.numbers)
    return f"with {checked(name, spec)} select line_id, {sim} sim_id, {at['time_iso']} time_iso, epoch_ms(strptime({at['time_iso']},'%Y-%m-%dT%H:%M:%S')) time_millis, {numbers} from {name}_e where len(errors)=0"
