"""Batch bookkeeping: queue, results, admission, naming, archive layout, manifests and caches, retry histories, timing.

`events` stands in for logs, `documents` for files, orders and lineitem for parents and children."""

from __future__ import annotations

from markfield.functions.dialect import clamp, fl, jsround

# Limits and defaults.
MAX_ITEMS, MAX_BYTES, RESERVE = 40, 220 * 1024 * 1024, 48 * 1024 * 1024
FIRST_ESTIMATE = {"int8": 16.0, "fp32": 40.0}
# Messages of errors that mean out of memory, of inputs that cannot be read any more, and of a worker that
# has to be built anew.
OOM = (
    "out of memory", "memory access out of bounds", "could not allocate memory", "cannot enlarge memory", "allocation failed", "std::bad_alloc",
    r"aborted\s*\(\s*oom\s*\)",
)
UNREADABLE = "解码|打不开|decode|Load failed|TypeError"
POISONED = "120 秒|初始化超过|内存不足|推理超时|推理线程"
# Texts of the states, prefixes of output names, and the labels of the sources in their order.
SELECT_AGAIN, OUT_OF_MEMORY = "这张图片来自上次缓存，数据已失效，请重新选择图片", "设备内存不足；建议使用 INT8、关闭其他 Safari 标签页后重试"
WAITING, WORKING, DONE, NO_MARK, NO_OCR, KEPT, NOT_STORED, FAILED, UNKNOWN = "等待处理", "处理中", "已去除", "未识别水印", "文字识别暂不可用", "保持原图", " · 结果未落盘", "失败：", "未知原因"
CLEAN, ORIGINAL = "去水印", "原图"
SOURCES = ("jsDelivr", "HuggingFace", "同源 Pages")
RETRIES, SLOW = 4, 120 * 1024


def items(d) -> str:
    """Files of a queue: documents stand in, MAX_ITEMS a batch."""
    ext = "case doc_id % 7 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.webp' when 4 then '.heic' when 5 then '' else '.tar.gz~' end"
    status = "case doc_id % 6 when 0 then 'pending' when 1 then 'running' when 2 then 'done' when 3 then 'unchanged' when 4 then 'failed' else 'done' end"
    return f"""it as (select doc_id as id, concat(source, '-', cast(doc_id as varchar(20)), {ext}) as name, case doc_id % 5 when 0 then 'image/jpeg' when 1 then 'image/webp' when 2 then 'image/heic' when 3 then 'image/heif' else null end as mime,
      case when doc_id % 23 = 0 then 0 else n_chars end as size, {status} as status, case when doc_id % 4 = 0 then 'int8' when doc_id % 9 = 0 then null else 'fp32' end as model, {d.idiv('doc_id', MAX_ITEMS)} as batch, doc_id % 8 = 3 as persisted, doc_id % 3 = 0 as has_blob,
      case when doc_id % 10 = 0 then '.png' end as output_ext, lang as provider, doc_id % 4 as regions, concat(cast(doc_id % 90 as varchar(20)), ' s') as elapsed, doc_id % 12 = 2 as not_stored, doc_id % 18 = 3 as no_ocr,
      case when doc_id % 12 = 1 then concat('step ', cast(doc_id % 5 as varchar(20))) end as progress, case when doc_id % 24 = 4 then null else concat('E', cast(doc_id % 7 as varchar(20))) end as error from {d.t('documents')})"""


def accept_files(d):
    return f"with {items(d)} select id, name from it where size > 0 and name is not null"


def needs_processing(d):
    return f"with {items(d)} select id, status in ('pending', 'running', 'failed') or coalesce(model, '') <> 'int8' as needed from it"


def has_result(d):
    return f"with {items(d)} select id, status in ('done', 'unchanged') and (has_blob or persisted) as available from it"


def state_text(d):
    stored = f"case when not_stored then '{NOT_STORED}' else '' end"
    return f"""with {items(d)} select id, case status when 'pending' then '{WAITING}' when 'running' then coalesce(progress, '{WORKING}')
      when 'done' then concat('{DONE} · ', coalesce(provider, ''), ' · ', cast(case when coalesce(regions, 0) = 0 then 1 else regions end as varchar(20)), ' 处 · ', elapsed, {stored})
      when 'unchanged' then concat(case when no_ocr then '{NO_OCR}' else '{NO_MARK}' end, ' · {KEPT}', {stored}) else concat('{FAILED}', coalesce(error, '{UNKNOWN}')) end as label from it"""


def errors(d) -> str:
    return f"""e as (select event_id as id, event_id % 2 = 0 as restored, case event_id % 12 when 0 then 'RangeError: Out of Memory' when 1 then 'std::bad_alloc' when 2 then 'Error: room is full' when 3 then 'Aborted ( OOM )' when 4 then 'memory access out of bounds'
      when 5 then 'The image could not be decoded' when 6 then '推理超时' when 7 then '初始化超过 120 秒' when 8 then 'Array buffer allocation failed' when 9 then 'RangeError: invalid array length' when 10 then 'Load failed' else event_type end as message from {d.t('events')})"""


def is_oom(d, message: str) -> str:
    return d.match(message, f"(?i){'|'.join(OOM)}")


def friendly(d, message: str, restored: str) -> str:
    return f"case when {restored} and {d.match(message, '(?i)' + UNREADABLE)} then '{SELECT_AGAIN}' else {message} end"


def error_class(d):
    return f"with {errors(d)} select id, {friendly(d, 'message', 'restored')} as text from e"


def oom_classify(d):
    return f"with {errors(d)} select id, {is_oom(d, 'message')} as oom from e"


def session_poison(d):
    """Errors after which the worker is built anew, judged on the text that the user sees."""
    return f"with {errors(d)}, t as (select id, case when {is_oom(d, 'message')} then '{OUT_OF_MEMORY}' else {friendly(d, 'message', 'restored')} end as text from e) select id, text, {d.match('text', POISONED)} as rebuild from t"


def _ext(name: str = "name") -> str:
    return f"lower(regexp_extract({name}, '[.][^.]+$', 0))"


def _output_ext() -> str:
    return f"case when {_ext()} in ('.jpg', '.jpeg') then '.jpg' else '.png' end"


def output_format(d):
    return f"with {items(d)} select id, case when {_ext()} in ('.jpg', '.jpeg') then 'image/jpeg' else 'image/png' end as mime, {_output_ext()} as ext, case when {_ext()} in ('.jpg', '.jpeg') then 0.95 end as quality from it"


def original_format(d):
    known = "case mime when 'image/jpeg' then '.jpg' when 'image/webp' then '.webp' when 'image/heic' then '.heic' when 'image/heif' then '.heif' else '.png' end"
    return f"with {items(d)} select id, case when {_ext()} <> '' then {_ext()} else {known} end as ext, coalesce(mime, case when {_ext()} <> '' then 'application/octet-stream' else 'image/png' end) as mime from it"


def _stem(d) -> str:
    return d.replace("name", "[.][^.]+$", "")


def _prefix() -> str:
    return f"case when status = 'done' then '{CLEAN}' else '{ORIGINAL}' end"


def output_name(d):
    return f"with {items(d)} select id, concat({_prefix()}, '-', {_stem(d)}, coalesce(output_ext, {_output_ext()})) as name from it where status in ('done', 'unchanged')"


def zip_names(d) -> str:
    number = "case when i < 1000 then lpad(cast(i as varchar(20)), 3, '0') else cast(i as varchar(20)) end"
    return f"""{items(d)}, n as (select *, row_number() over (partition by batch order by id) as i from it where status in ('done', 'unchanged')),
    z as (select id, batch, i, size, concat({_prefix()}, '-', {number}, '-', {_stem(d)}, coalesce(output_ext, {_output_ext()})) as entry from n)"""


def zip_entry_names(d):
    return f"with {zip_names(d)} select id, entry from z"


def zip_layout(d):
    """Local header offsets of stored entries: a running sum; the central directory follows."""
    size = f"30 + {'octet_length(entry)' if d.name == 'spark' else 'strlen(entry)'} + size"
    return f"with {zip_names(d)} select id, batch, cast(coalesce(sum({size}) over (partition by batch order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as at, cast(sum({size}) over (partition by batch) as bigint) as central from z"


def dos_datetime(d):
    y, mo, da, h, mi, s = (f"extract({p} from ts)" for p in ("year", "month", "day", "hour", "minute", "second"))
    return f"select event_id as id, cast({h} * 2048 + {mi} * 32 + {fl(f'{fl(s)} / 2.0')} as bigint) as time_, cast(greatest(0, {y} - 1980) * 512 + {mo} * 32 + {da} as bigint) as date_ from {d.t('events')}"


def adds(d) -> str:
    """Files that are added to a customer's list at once: an order's lines, with sizes."""
    return f"ad as (select o_custkey as list, o_orderkey as n, count(*) as files, cast(sum(l_quantity) as bigint) * 300000 as bytes from {d.t('orders')} join {d.t('lineitem')} on l_orderkey = o_orderkey group by o_custkey, o_orderkey)"


def batch_admission(d):
    """An addition is taken whole or not at all, by what the list would hold: too many items first, then too many bytes."""
    fits = f"s.files + e.files <= {MAX_ITEMS} and s.bytes + e.bytes <= {MAX_BYTES}"
    why = f"case when s.files + e.files > {MAX_ITEMS} then '超过 {MAX_ITEMS} 张' when s.bytes + e.bytes > {MAX_BYTES} then '原图超过 {MAX_BYTES // 1048576}MB' else '' end"
    if d.name == "spark":
        out = f"array_append(s.out, named_struct('n', e.n, 'reason', {why}))"
        step = f"named_struct('files', case when {fits} then s.files + e.files else s.files end, 'bytes', case when {fits} then s.bytes + e.bytes else s.bytes end, 'out', {out})"
        zero = "named_struct('files', 0L, 'bytes', 0L, 'out', cast(array() as array<struct<n:bigint,reason:string>>))"
        return f"with {adds(d)} select list, o.n as n, o.reason as reason from (select list, explode(aggregate(array_sort(collect_list(struct(n, files, bytes))), {zero}, (s, e) -> {step}).out) as o from ad group by list) z"
    return f"""with recursive {adds(d)}, r as (select *, row_number() over (partition by list order by n) as i from ad),
    w(list, i, n, files, bytes, reason) as (select list, cast(0 as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as hugeint), '' from (select distinct list from ad) u union all
      select e.list, e.i, e.n, case when {fits} then s.files + e.files else s.files end, case when {fits} then s.bytes + e.bytes else s.bytes end, {why} from w s join r e on e.list = s.list and e.i = s.i + 1)
    select list, n, reason from w where i > 0"""


def batch_bytes(d):
    return f"with {items(d)} select batch, count(*) as items, cast(sum(size) as bigint) as bytes from it group by batch"


def batch_totals(d):
    return f"with {items(d)} select batch, status, count(*) as n from it where status in ('done', 'unchanged', 'failed') group by batch, status"


def queue_summary(d):
    """Counts by status.  Stale rows have another model's result and are not pending; they are counted besides, and what is
    shown as to be done is pending and stale ones."""
    stale = "model is not null and model <> 'int8' and status <> 'pending'"
    tests = {"done": "status = 'done'", "unchanged": "status = 'unchanged'", "failed": "status = 'failed'", "pending": "status = 'pending'", "stale": stale, "to_do": f"status = 'pending' or ({stale})"}
    return f"with {items(d)} select batch, count(*) as items, " + ", ".join(f"cast({d.count_if(t)} as bigint) as {n}" for n, t in tests.items()) + " from it group by batch"


def capacity_check(d):
    return f"""with c as (select o_orderkey as id, cast(o_totalprice * 1000 as double) as extra, case when o_orderkey % 5 = 0 then null else o_custkey * 4000000.0 end as quota, o_custkey * 1000000.0 as used from {d.t('orders')})
    select id, case when quota is null then true else greatest(0.0, quota * 0.9 - used) >= extra + {RESERVE} end as fits from c"""


def result_upsert(d):
    """Last write of each key wins."""
    return f"select user_id as id, event_type as status, event_id as version from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {d.t('events')}) s where r = 1"


def result_delete(d):
    return f"select event_id as id, event_type as status from {d.t('events')} e where not exists (select 1 from {d.t('events')} x where x.user_id = e.user_id and x.event_type = 'error' and x.event_id % 40 = 0)"


def result_load(d):
    """The stored result of every key that is looked up: its last write, none if a deletion came later or nothing was kept."""
    return f"""with w as (select user_id as id, event_type as status, event_id as version, event_type = 'error' as gone, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {d.t('events')})
    select c_custkey as id, case when gone then null else status end as status, case when gone then null else version end as version from {d.t('customer')} left join w on w.id = c_custkey and r = 1"""


def storage_summary(d):
    """Use, quota and what is free; nothing is known without an estimate."""
    return f"""with u as (select user_id as id, count(*) as n, cast(sum(event_id) as bigint) as used from {d.t('events')} group by user_id)
    select id, case when n % 4 = 0 then null else used end as used, case when n % 4 = 0 then null else n * 100000 end as quota, case when n % 4 = 0 then null else greatest(0, n * 100000 - used) end as free from u"""


def restore_results(d):
    return f"""with r as (select user_id as id, max(event_id) as result from {d.t('events')} where event_type = 'purchase' group by user_id)
    select c_custkey as id, coalesce(result, -1) as result, case when result is null then 'pending' else 'done' end as status from {d.t('customer')} left join r on r.id = c_custkey"""


def last_result(d):
    return f"select batch, max(id) as id from (with {items(d)} select * from it where status in ('done', 'unchanged') and (has_blob or persisted)) s group by batch"


def batch_explode(d):
    """A batch's ids and files correspond by position; a missing id stays null."""
    src = f"(select user_id as batch, {d.gather('case when event_id % 9 = 0 then null else event_id end', 'event_id')} as ids, {d.gather('event_type', 'event_id')} as files from {d.t('events')} group by user_id)"
    if d.name == "spark":
        return f"select batch, cast(p as bigint) as at, z.ids as id, z.files as file from (select batch, posexplode(arrays_zip(ids, files)) as (p, z) from {src} s) t"
    return f"select batch, unnest(range(len(files))) as at, unnest(ids) as id, unnest(files) as file from {src} s"


def passthrough_bytes(d):
    return f"with {items(d)} select it.id, {'octet_length(text)' if d.name == 'spark' else 'strlen(text)'} as bytes, md5(text) as content from it join {d.t('documents')} on doc_id = id where status = 'unchanged'"


def crc32(d):
    """CRC-32 of whole contents."""
    return f"select doc_id as id, crc32(cast(coalesce(text, '') as binary)) as crc from {d.t('documents')}"


def timings(d) -> str:
    return f"tm as (select user_id as model, case when user_id % 2 = 0 then 'int8' else 'fp32' end as kind, event_id as n, case when event_id % 7 = 0 then -value else value end as s from {d.t('events')})"


def smoothed(d) -> str:
    """Smoothed seconds of a model: an ordered fold from the model's first estimate, rounded to two places at every step;
    what is not positive is ignored."""
    first = f"case when kind = 'int8' then cast({FIRST_ESTIMATE['int8']} as double) else cast({FIRST_ESTIMATE['fp32']} as double) end"
    step = "case when s is null or isnan(s) or s <= 0 then t else floor((0.65 * t + 0.35 * s) * 100 + 0.5) / 100 end"
    if d.name == "spark":
        return f"{timings(d)}, sm as (select model, kind, aggregate(transform(array_sort(collect_list(struct(n, s))), z -> z.s), {first}, (t, s) -> {step}) as t from tm group by model, kind)"
    return f"""{timings(d)}, e as (select *, row_number() over (partition by model order by n) as r from tm),
    walk(model, kind, r, t) as (select model, kind, cast(0 as bigint), {first} from (select distinct model, kind from tm) u union all select e.model, e.kind, e.r, {step} from walk w join e on e.model = w.model and e.r = w.r + 1),
    sm as (select model, kind, t from walk qualify row_number() over (partition by model order by r desc) = 1)"""


def _recursive(d) -> str:
    return "with recursive" if d.name == "duck" else "with"


def timing_ewma(d):
    return f"{_recursive(d)} {smoothed(d)} select model, round(t, 2) as seconds from sm"


def batch_estimate(d):
    """Time that is left for `n` images at the model's smoothed seconds: minutes from 60 seconds on, hidden for none."""
    text = f"case when s >= 60 then concat('约 ', cast(cast(ceil(s / 60.0) as bigint) as varchar(20)), ' 分钟') else concat('约 ', cast(s as varchar(20)), ' 秒') end"
    return f"""{_recursive(d)} {smoothed(d)}, c as (select model, t, model % 9 as n from sm), q as (select *, greatest(1, {jsround('t * n')}) as s from c)
    select model, n, n <= 0 as hidden, case when n <= 0 then '' else concat(cast(n as varchar(20)), ' 张预计 ', {text}, '；请保持页面在前台，每完成一张会立即保存。') end as text from q"""


def stratified_sample(d, n: int = 20):
    """Round robin over folders: every folder's first file, then every second one."""
    return f"""with {items(d)}, r as (select id, batch, row_number() over (partition by batch order by name) as turn from it)
    select id, batch from (select *, row_number() over (order by turn, batch) as k from r where turn <= {n}) s where k <= {n}"""


def parity_diff(d):
    """Expected and actual decisions by file: six fields are equal, the gain within 0.021 where one is expected, and files
    called clean have no mark."""
    at = "l.doc_id % 40 as x, l.doc_id % 30 as y, case when toxic = 1 then 48 else 96 end as size, l.doc_id % 6 as action, case when quality = 1 then 'cleaned' when toxic = 1 then 'needs-inpaint' else 'not-found' end as status, case when quality = 1 then 'reverse' else 'template' end as method"
    same = " and ".join(f"e.{c} = a.{c}" for c in ("status", "method", "x", "y", "size", "action"))
    return f"""with e as (select l.doc_id, concat(case when l.doc_id % 11 = 0 then 'Clean_' else 'image_' end, d.source) as name, {at}, case when quality = 1 then 0.35 + (l.doc_id % 80) * 0.02 end as gain from {d.t('labels')} l join {d.t('documents')} d on d.doc_id = l.doc_id),
    a as (select doc_id, status, case when doc_id % 19 = 0 then 'other' else method end as method, case when doc_id % 17 = 0 then x + 1 else x end as x, y, size, action, coalesce(gain, 0) + (doc_id % 4) * 0.01 as gain from e)
    select e.doc_id, {same} and (e.gain is null or abs(e.gain - a.gain) <= 0.021) and not ({d.match('e.name', '(?i)^clean_')} and a.status <> 'not-found') as same from e join a on a.doc_id = e.doc_id"""


def parity_negatives(d):
    return f"select doc_id from {d.t('documents')} d where not exists (select 1 from {d.t('labels')} l where l.doc_id = d.doc_id)"


def parity_fixtures(d):
    return f"select doc_id, source from {d.t('documents')} d where exists (select 1 from {d.t('labels')} l where l.doc_id = d.doc_id)"


def manifest_except(d):
    return f"select distinct source, lang from {d.t('documents')} except select source, lang from {d.t('documents')} where doc_id in (select doc_id from {d.t('labels')})"


def chunks(d) -> str:
    return f"ch as (select l_orderkey as file, l_linenumber as idx, cast(floor(l_quantity) as bigint) * 1000 + l_partkey % 1000 as size, l_suppkey as src from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as one from {d.t('lineitem')}) s where one = 1)"


def chunk_offsets(d):
    return f"with {chunks(d)} select file, idx, cast(coalesce(sum(size) over (partition by file order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as at, cast(sum(size) over (partition by file) as bigint) as total from ch"


def chunk_split(d, part: int = 16384):
    """All parts of a file, as many as it has."""
    return f"with {chunks(d)}, f as (select file, cast(sum(size) as bigint) as total from ch group by file), k as (select file, total, {d.upto(d.idiv(f'total + {part - 1}', part), 'k')} from f) select file, k, k * {part} as at, least({part}, total - k * {part}) as size from k"


def chunk_cache_key(d):
    return f"with {chunks(d)} select file, idx, concat('models/', cast(file as varchar(20)), '/model.part.', lpad(cast(idx as varchar(20)), 3, '0'), '.bin') as key, {d.replace('''concat('https://host/a/', cast(file as varchar(20)), '?v=', cast(idx as varchar(20)))''', '[?].*$', '')} as url from ch"


def cached(d) -> str:
    return f"{chunks(d)}, cache as (select file, idx, case when src % 10 = 1 then size - 1 else size end as size from ch where src % 4 <> 0)"


def cache_coverage(d):
    return f"with {cached(d)} select ch.file, count(*) as total, count(cache.idx) as valid from ch left join cache on cache.file = ch.file and cache.idx = ch.idx and cache.size = ch.size group by ch.file"


def cache_evict(d):
    return f"with {cached(d)} select cache.file, cache.idx from cache join ch on ch.file = cache.file and ch.idx = cache.idx where cache.size <> ch.size"


def runtime_ready(d):
    return f"with {cached(d)} select ch.file, bool_and(cache.idx is not null) as ready from ch left join cache on cache.file = ch.file and cache.idx = ch.idx and cache.size = ch.size group by ch.file"


# What a model's cache is called.
CACHED, MISSING, UNCERTAIN = "已缓存", "未缓存", "未确认"


def cache_presentation(d):
    """Label, class and visibility of a model's cache: hidden without support, uncertain if unknown, cached only where all
    parts are there and the runtime is ready."""
    return f"""with {cached(d)}, c as (select ch.file, count(*) as total, count(cache.idx) as have from ch left join cache on cache.file = ch.file and cache.idx = ch.idx and cache.size = ch.size group by ch.file),
    s as (select file, total, have, file % 13 <> 0 as supported, file % 11 = 0 as unknown, file % 3 <> 0 as ready from c), t as (select file, supported, case when not supported then '' when unknown then '{UNCERTAIN}' when total > 0 and have = total and ready then '{CACHED}' else '{MISSING}' end as text from s)
    select file, text, case text when '' then '' when '{UNCERTAIN}' then 'partial' when '{CACHED}' then 'cached' else 'missing' end as class, not supported as hidden from t"""


def source_order(d):
    """Mirror, hub, own site; a model without a hub address has two.  Preferring the hub moves it to the front, preferring
    the own site turns the order round; the source that worked last in this session goes first."""
    names = " union all ".join(f"select {k} as k, '{n}' as name" for k, n in enumerate(SOURCES))
    rank = "case when mode = 1 and k = 1 then -1 when mode = 2 then 2 - k else k end"
    return f"""with u as (select user_id, min(event_id) % 3 as mode, min(event_id) % 4 as worked, min(event_id) % 5 > 0 as hub from {d.t('events')} group by user_id), s as ({names})
    select user_id, name, row_number() over (partition by user_id order by case when k = worked then 0 else 1 end, {rank}) as place from u cross join s where hub or k <> 1"""


def slow_switch(d):
    """Source of every part of a download: the one that gave the part before, until the first part that came slower than
    SLOW bytes a second; from the next one on another source is taken, once."""
    return f"""with {chunks(d)}, t as (select file, idx, size * 1.0 / greatest(0.1, 0.05 + (src % 40) * 0.01) as speed from ch), f as (select file, min(case when speed < {SLOW} then idx end) as first from t group by file)
    select t.file, t.idx, speed < {SLOW} as slow, case when first is not null and t.idx > first then '{SOURCES[1]}' else '{SOURCES[0]}' end as source from t join f on f.file = t.file"""


def range_check(d):
    """Answers to a range request: which are taken, and why others are not."""
    return f"""with q as (select event_id as id, event_id % 3 = 0 as no_resume, case when event_id % 4 = 0 then 0 else (event_id % 5) * 1000 end as offset_, case event_id % 11 when 0 then 200 when 1 then 404 else 206 end as status, case when event_id % 4 = 1 and event_id % 3 > 0 then 512 else 0 end as have, 4096 as size from {d.t('events')}),
    r as (select *, offset_ + have as first, offset_ + size - 1 as last, case when id % 13 = 0 then null when id % 17 = 0 then offset_ + have + 1 else offset_ + have end as got, case when id % 19 = 0 then 7 else 90000 end as total from q)
    select id, case when status >= 300 then concat('HTTP ', cast(status as varchar(20))) when status <> 206 and not (status = 200 and offset_ = 0 and have = 0) then 'no resume'
      when not no_resume and status = 206 and (got is null or got <> first) then 'range' when not no_resume and got is not null and total <> 90000 then 'total' else '' end as reason from r"""


def attempts(d) -> str:
    return f"att as (select user_id as run, event_id as n, event_type as kind, value from {d.t('events')})"


def chunk_retry_fold(d):
    """Attempts of a download in order: RETRIES a source, bytes go on from where the source broke off, another source starts
    from 0, and the first source (which cannot resume) from 0 at every attempt.  A part is done when an attempt ends it."""
    got = "cast(floor(value * 5) as bigint)"
    return f"""with {attempts(d)}, r as (select run, n, kind, {got} as got, row_number() over (partition by run order by n) - 1 as i from att), s as (select *, {d.idiv('i', RETRIES)} as source from r),
    h as (select *, coalesce(sum(got) over (partition by run, source order by n rows between unbounded preceding and 1 preceding), 0) as before from s)
    select run, n, source, i % {RETRIES} + 1 as attempt, cast(case when source = 0 then 0 else before end as bigint) as resumes_at, case when kind = 'error' then least(8000, 800 * (i % {RETRIES} + 1)) else 0 end as backoff_ms from h"""


def oom_retry_fold(d):
    """Threads 4, 2, 1: an out-of-memory failure lowers them at most twice, any other failure ends the run."""
    if d.name == "spark":
        fold = "aggregate(array_sort(collect_list(struct(n, kind))), named_struct('threads', 4L, 'retries', 0L, 'over', false), (s, e) -> case when s.over or e.kind = 'view' then s when e.kind = 'error' and s.threads > 1 and s.retries < 2 then named_struct('threads', s.threads div 2, 'retries', s.retries + 1, 'over', false) else named_struct('threads', s.threads, 'retries', s.retries, 'over', true) end)"
        return f"with {attempts(d)} select run, s.threads, s.retries, s.over as ended from (select run, {fold} as s from att group by run) z"
    return f"""with recursive {attempts(d)}, r as (select run, kind, row_number() over (partition by run order by n) as i from att),
    w(run, i, threads, retries, over_) as (select run, cast(0 as bigint), cast(4 as bigint), cast(0 as bigint), false from (select distinct run from att) u union all
      select r.run, r.i, case when not over_ and kind = 'error' and threads > 1 and retries < 2 then threads // 2 else threads end, case when not over_ and kind = 'error' and threads > 1 and retries < 2 then retries + 1 else retries end,
        over_ or not (kind = 'view' or (kind = 'error' and threads > 1 and retries < 2)) from w join r on r.run = w.run and r.i = w.i + 1)
    select run, threads, retries, over_ as ended from w qualify row_number() over (partition by run order by i desc) = 1"""


# Why a request of a worker ends without a result.
REPLACED, LATE, NOT_READY, TIMEOUT = "模型已切换，旧推理已终止", "本张推理超过 30 秒未返回，已终止推理线程", "模型尚未初始化", 30


def inference_outcome(d):
    """How every request to a worker ends.  A purchase starts a worker anew (a generation), an error without a request ends
    it, a click is a request with an answer some seconds later, or none.  What comes first counts: the answer, the request's
    time limit, which ends the worker for all, or the worker's end; requests without a worker fail at once."""
    never = "1000000000"
    ends = ", ".join(f"coalesce(g.{c}, {never}) as {c}" for c in ("replaced", "broken", "late"))
    return f"""with e as (select user_id as session, event_id as t, event_type as kind, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as generation from {d.t('events')}),
    r as (select session, generation, t, case t % 5 when 1 then 'error' when 3 then 'none' else 'result' end as answer, t + 1 + t % 37 as answered from e where kind = 'click'),
    l as (select *, case when answer = 'none' or answered > t + {TIMEOUT} then t + {TIMEOUT} end as own_late from r),
    w as (select session, generation, min(case when kind = 'purchase' then t end) as started, min(case when kind = 'error' then t end) as broken from e group by session, generation),
    late as (select session, generation, min(own_late) as late from l group by session, generation),
    g as (select w.session, w.generation, n.started as replaced, w.broken, late.late from w left join late on late.session = w.session and late.generation = w.generation left join w n on n.session = w.session and n.generation = w.generation + 1),
    z as (select l.*, {ends} from l join g on g.session = l.session and g.generation = l.generation), y as (select *, least(replaced, broken, late) as ends from z)
    select session, t as request, case when generation = 0 or t > ends then '{NOT_READY}' when own_late is null and answered <= ends then answer when own_late <= ends then '{LATE}' when ends = replaced then '{REPLACED}' when ends = broken then 'worker' else '{LATE}' end as outcome from y"""


def settle_within(d):
    """A promise's value if it is kept within the limit, else what stands in for it; a broken one counts as not kept."""
    return f"select event_id as id, case when event_type <> 'error' and value <= 20 then event_type else 'fallback' end as settled, least(value, 20.0) as waited from {d.t('events')}"


def result_blob(d):
    """Where an item's result comes from: what it holds, what is stored for it, or the error that it is gone."""
    return f"with {items(d)}, st as (select id from it where persisted and id % 5 <> 0) select it.id, case when has_blob then 'held' when persisted and st.id is not null then 'stored' else concat(name, ' 的结果已被浏览器清理，请重新处理') end as source from it left join st on st.id = it.id where status in ('done', 'unchanged')"


def thread_policy(d):
    return f"""with p as (select event_id as id, event_id % 2 = 0 as isolated, case when event_id % 5 = 0 then null else event_id % 9 end as hw, case when event_id % 3 = 0 then null else event_id % 4 end as cap from {d.t('events')}),
    c as (select *, case when isolated then least(4, case when coalesce(hw, 0) = 0 then 2 else hw end) else 1 end as ceiling from p)
    select id, case when coalesce(cap, 0) > 0 then least(ceiling, cap) else ceiling end as threads, case when ceiling > 2 then 2 else 1 end as lowered from c"""


def scan_files(d):
    return f"with {items(d)} select id, name, size from it where size > 0"


QUERIES = {f.__name__: f for f in (
    scan_files, accept_files, needs_processing, has_result, state_text, error_class, oom_classify, output_format, original_format, output_name, zip_entry_names,
    zip_layout, dos_datetime, batch_admission, batch_bytes, batch_totals, queue_summary, capacity_check, result_upsert, result_delete, restore_results,
    last_result, batch_explode, passthrough_bytes, crc32, session_poison, slow_switch, range_check, timing_ewma, batch_estimate, stratified_sample, parity_diff, parity_negatives, parity_fixtures,
    manifest_except, result_load, storage_summary, cache_presentation, chunk_offsets, chunk_split, chunk_cache_key, cache_coverage, cache_evict, runtime_ready, source_order, chunk_retry_fold, oom_retry_fold,
    thread_policy, inference_outcome, settle_within, result_blob,
)}
#: DuckDB has no CRC-32.
NO_SQL = ("crc32",)
