"""Independent DuckDB SQL for the registered queries, in naive forms.

Fixtures are written out again here; matching, as-of, idle and cron rules use other methods
than the Spark side (regular expressions, tick grids, row numbers, correlated joins).
"""

from __future__ import annotations

from evspark.settings import DEFAULTS
from evspark.workload.fixtures import CRON_END, CRON_START, HORIZON, ROSTER_END, ROSTER_START

P = DEFAULTS.label_prefix

ORACLE: dict[str, str] = {}

# feeds

KAFKA = """kafka as (
  select 'kafka' family, (o_orderkey % 4) * 17592186044416 + o_orderkey // 4 seq, (1704067200 + o_orderkey * 7919 % 3456000) * 1000000 us,
         '' namespace, 'orders-' || o_orderstatus source, 'kafka' "type", '' "version",
         o_custkey || ':' || o_orderpriority "data",
         md5('kafka#orders-' || o_orderstatus || '#' || ((o_orderkey % 4) * 17592186044416 + o_orderkey // 4)) uuid
  from orders)"""
MQTT = """mqtt as (
  select 'mqtt' family, conv_id * 100 + turn seq, (1704067200 + (conv_id * 100 + turn) * 7919 % 3456000) * 1000000 us,
         '' namespace, 'conv/' || (conv_id % 20) || '/' || role source, 'mqtt' "type", '' "version", "text" "data", '' uuid
  from conversations)"""
REDIS = """redis as (
  select 'redis' family, doc_id seq, (1704067200 + doc_id * 1234577 % 3456000) * 1000000 us,
         '' namespace, source, '' "type", '' "version", "text" "data", '' uuid
  from documents)"""
HTTP = """http as (
  select 'http' family, page_id seq, (1704067200 + page_id * 7919 % 2419200) * 1000000 us,
         '' namespace, '' source, 'http' "type", ((1704067200 + page_id * 7919 % 2419200) * 1000000000)::varchar "version",
         html "data", case when page_id % 5 = 0 then 'req-' || page_id else md5('http##' || page_id) end uuid,
         regexp_extract(url, '^https?://([^/:?#]+)', 1) host, page_id % 4 lang,
         page_id % 3 <> 2 and page_id % 11 <> 0 accepted
  from pages)"""
K8S = """k8s as (
  select 'k8s_events' family, event_id seq, epoch_us(ts) us, 'ns-' || (user_id % 10) namespace,
         'user-' || user_id source, event_type "type", 'v' || (event_id % 3) "version", props "data", '' uuid,
         user_id
  from events where event_id % 10 < 9)"""
CLOUD = """cloud as (
  select 'cloud_events' family, event_id seq, epoch_us(ts) us, '' namespace, 'user-' || (user_id % 20) source,
         event_type "type", case when event_id % 7 = 0 then '0.3' else '1.0' end "version", props "data", '' uuid
  from events)"""
ENV = 'seq, us as ts_us, namespace, source, "type", "version", "data", uuid'

for _name, _cte, _rel in [
    ("kafka_envelope", KAFKA, "kafka"), ("mqtt_envelope", MQTT, "mqtt"), ("redis_envelope", REDIS, "redis"),
    ("http_envelope", HTTP, "http"), ("k8s_envelope", K8S, "k8s"), ("cloud_envelope", CLOUD, "cloud"),
]:
    ORACLE[_name] = f"with {_cte} select {ENV} from {_rel}"

ORACLE["kafka_end_offsets"] = """
select 'orders-' || o_orderstatus topic, (o_orderkey % 4)::int "partition", max(o_orderkey // 4) + 1 end_offset
from orders group by all"""
ORACLE["kafka_latest_only"] = """
with r as (select 'orders-' || o_orderstatus topic, (o_orderkey % 4)::int "partition", o_orderkey // 4 "offset", o_orderkey::varchar "key" from orders)
select * from r where "offset" >= (select (max("offset") + 1) // 2 from r b where b.topic = r.topic and b."partition" = r."partition")"""
ORACLE["event_payload"] = f"""with {HTTP}
select seq, to_base64(encode(json_object('namespace', namespace, 'source', source, 'type', "type", 'version', "version",
  'data', "data", 'uuid', uuid)::varchar)) payload from http"""

# sensors

SENS = f"""s0 as (
  select s_suppkey x, s_suppkey // 14 j, s_suppkey % 7 tno, ((s_suppkey // 14 + s_suppkey // 280) % 5)::int kno from supplier),
sens as (
  select x, j, tno, kno, x created_seq,
    'ns-' || (x % 10) || '/sensor-' || x sensor_key, 'ns-' || (x % 10) ns,
    case when x % 29 = 28 then 'http'
      else (['k8s_events','cloud_events','k8s_http','kafka','redis','mqtt','cron'])[tno + 1] end ttype,
    x % 31 = 30 meta_empty,
    (['signup','click','view','purchase','error'])[j % 5 + 1] e_type,
    (['earliest','latest',null,'newest'])[j % 4 + 1] k_policy,
    case when j % 5 = 4 then '1.x' else '1.0.0' end k_version,
    'orders-' || (['O','F','P'])[j % 3 + 1] k_topic,
    (['0','3',null,'x1'])[j % 4 + 1] r_db,
    case when j % 8 = 5 then '' else 'password' end m_password,
    (['conv/' || (j % 20) || '/user', 'conv/+/' || case when j % 2 = 0 then 'user' else 'system' end,
      'conv/' || (j % 20) || '/#', 'conv/+/+', '#', 'conv/+/user/#'])[j % 6 + 1] m_filter,
    ([(x % 60) || ' ' || (x % 59) || ' ' || (x % 24) || ' * * *', '*/15 ' || (x % 60) || ' 3 * * ?',
      '0 0 ' || (x % 24) || ' ' || (x % 28 + 1) || ' * 1', '0 0 0 1 * *', '0 30 8-10 * * MON-fri',
      '0 0 12 29 2 *', '@every 1s', '0 5/20 1,2,3 */10 jan *'])[j % 8 + 1] c_cron,
    (['create','scale','delete','update',''])[x % 5 + 1] operation,
    (['Deployment','StatefulSet','Pod','Job','Policy'])[kno + 1] kind,
    (['deployments','statefulsets','pods','jobs','policies'])[kno + 1] resource,
    (['apps/v1','apps/v1','v1','batch/v1','policy/v1'])[kno + 1] api_version,
    case when x % 4 = 0 then '' else 'ns-' || (x % 10) end obj_ns,
    'obj-' || x name,
    case when x % 4 = 3 then null else x % 4 end replicas,
    case kno when 2 then ['main','side'] when 3 then ['job'] else [] end containers,
    x % 37 <> 36 has_template, x % 26 < 24 has_k8s, x % 26 = 24 has_http,
    x % 41 = 40 no_manifest, x % 41 <> 40 and x % 43 = 42 bad_manifest,
    x % 3 <> 0 idle_enabled,
    case x % 50 when 48 then '-5' when 23 then '99999999999999' else (['','0','3600','86400','abc'])[x % 5 + 1] end idle_label,
    x % 3 <> 0 has_target,
    case when x % 13 = 12 then 'sms' when x % 11 = 10 then 'http' else 'events' end target_type
  from s0)"""
VALID = """checked as (
  select *, coalesce(
    case
      when meta_empty then 'trigger.meta_missing'
      when ttype = 'http' then 'trigger.type_not_supported'
      when ttype = 'mqtt' and j % 9 = 4 then 'mqtt.ping_timeout_not_a_number'
      when ttype = 'mqtt' and m_password = '' then 'mqtt.credentials_missing'
      when ttype = 'cron' and c_cron like '@%' then 'cron.not_valid'
      when ttype = 'redis' and r_db = 'x1' then 'redis.db_not_a_number'
      when ttype = 'kafka' and k_policy = 'newest' then 'kafka.offset_policy_unknown'
      when ttype = 'kafka' and k_version = '1.x' then 'kafka.version_not_valid'
      when ttype = 'kafka' and j % 6 = 4 then 'kafka.allow_idle_not_a_boolean'
      when ttype = 'k8s_http' and (not has_template or not has_k8s or no_manifest) then 'http.resource_missing'
      when ttype = 'k8s_http' and operation not in ('scale', 'create') then 'http.operation_not_supported'
      when ttype = 'k8s_http' and bad_manifest then 'http.manifest_not_valid'
      when ttype = 'k8s_http' and kind not in ('Pod', 'StatefulSet', 'Deployment') then 'http.kind_not_supported'
    end,
    case
      when not has_template then 'actor.template_missing'
      when has_k8s and no_manifest then 'actor.source_missing'
      when has_k8s and bad_manifest then 'actor.manifest_not_valid'
      when has_http then 'actor.http_not_supported'
      when not has_k8s then 'actor.template_empty'
    end,
    case when has_target and target_type = 'sms' then 'target.type_not_supported' end,
    case when idle_enabled and idle_label like '-%' then 'idle.negative'
         when idle_enabled and length(idle_label) > 10 then 'idle.too_long' end) error
  from sens),
ok as (select * from checked where error is null)"""


def generations(rel: str) -> str:
    """Start a and end b of each sensor's generations."""
    day, zero = 86400000000, 1704067200000000
    return f"""lens as (select *, case when x % 5 in (2, 3) then 20 else 2 end len from {rel}),
gens as (
  select *, 1::bigint generation, {zero} + (x % 9) * {day} a, {zero} + (x % 9 + len) * {day} b from lens
  union all
  select *, 2::bigint, {zero} + (x % 9 + len + 1) * {day}, {zero} + (x % 9 + len + 1 + len // 2) * {day} from lens where x % 2 = 0)"""


def first_come(name: str, regs: str, key: str) -> str:
    """Owners of keys that are taken until their owner ends: a walk from each owner to the next one that found the key free."""
    return f"""{name}_r as (select *, row_number() over (partition by {key} order by a, created_seq, sensor_key) n from ({regs})),
{name}_x as (select r.{key}, r.n, min(q.n) nx from {name}_r r join {name}_r q on q.{key} = r.{key} and q.n > r.n and q.a >= r.b group by 1, 2),
{name}_w as (select {key}, n from {name}_r where n = 1 union all select x.{key}, x.nx from {name}_w w join {name}_x x on x.{key} = w.{key} and x.n = w.n),
{name} as (select r.* from {name}_r r join {name}_w w on w.{key} = r.{key} and w.n = r.n)"""


# at event time the key belongs to the latest registration so far, if that still runs
AT_KEY = """to_k8s as (select * from (
  select k.*, g.sensor_key, g.generation, g.b, row_number() over (partition by k.seq order by g.a desc, g.created_seq desc) rn
  from k8s k join gens g on g.ttype = 'k8s_events' and not g.meta_empty and k."type" = g.e_type and k."version" = 'v' || (g.j % 3)
    and k.namespace = 'ns-' || (g.j % 10) and g.a <= k.us) where rn = 1 and us < b),
to_cloud as (select * from (
  select c.*, g.sensor_key, g.generation, g.b, row_number() over (partition by c.seq order by g.a desc, g.created_seq desc) rn
  from cloud c join gens g on g.ttype = 'cloud_events' and not g.meta_empty and c.source = 'user-' || (g.j % 20) and c."type" = g.e_type
    and (c."version" = '0.3') = (g.j % 4 = 3) and g.a <= c.us) where rn = 1 and us < b)"""
AT_HTTP = f"""hosted_g as (
  select g.*, unnest(case when a1.host is null and b1.host is null
    then ['h' || g.j || '.example.com', 'www.h' || g.j || '.example.com'] else list_distinct([coalesce(a1.host, b1.host), coalesce(b1.host, a1.host)]) end) host
  from gens g left join http a1 on a1.seq = g.x left join http b1 on b1.seq = g.x - 7
  where g.ttype = 'k8s_http' and not g.meta_empty),
{first_come('hown', 'select host, a, b, created_seq, sensor_key, generation from hosted_g', 'host')},
{first_come('lown', "select j % 4 lang, a, b, created_seq, sensor_key, generation from gens where ttype = 'k8s_http' and not meta_empty", 'lang')},
to_host as (select h.*, o.sensor_key, o.generation from http h join hown o on o.host = h.host and h.us >= o.a and h.us < o.b where accepted),
to_header as (
  select h.*, o.sensor_key, o.generation from http h join lown o on o.lang = h.lang and h.us >= o.a and h.us < o.b
  where accepted and not exists (select 1 from hown p where p.host = h.host and h.us >= p.a and h.us < p.b))"""
AT_TOPIC = """to_topic as (
  select m.*, g.sensor_key, g.generation from kafka m join gens g on g.ttype = 'kafka' and not g.meta_empty and m.source = g.k_topic
    and m.us >= g.a and m.us < g.b
  union all
  select m.*, g.sensor_key, g.generation from redis m join gens g on g.ttype = 'redis' and not g.meta_empty and m.source = 'src' || (g.j % 20)
    and m.us >= g.a and m.us < g.b),
to_mqtt as (
  select m.*, g.sensor_key, g.generation from mqtt m join gens g on g.ttype = 'mqtt' and not g.meta_empty and m.us >= g.a and m.us < g.b
  and regexp_full_match(m.source, case when g.m_filter = '#' then '.*'
    else regexp_replace(replace(g.m_filter, '+', '[^/]*'), '/#$', '(/.*)?') end)),
to_cron as (select c.*, g.generation from cron c join gens g using (sensor_key) where c.us >= g.a and c.us < g.b)"""


def cron(rel: str) -> str:
    """Ticks of all schedules of ``rel``, from lists of seconds, minutes and hours and a calendar."""
    return f"""c_f as (select *, j % 8 form from {rel} where ttype = 'cron' and not meta_empty and j % 8 <> 6),
c_parts as (select *,
  case form when 0 then [x % 60] when 1 then [0, 15, 30, 45] else [0] end sec_list,
  case form when 0 then [x % 59] when 1 then [x % 60] when 4 then [30] when 7 then [5, 25, 45] else [0] end min_list,
  case form when 0 then [x % 24] when 1 then [3] when 2 then [x % 24] when 3 then [0] when 4 then [8, 9, 10] when 5 then [12] else [1, 2, 3] end hour_list
  from c_f),
c_d as (select unnest(generate_series(timestamp '{CRON_START}', timestamp '{CRON_END}', interval 1 day)) dt),
c_hits as (select p.*, dt from c_parts p, c_d where case form
  when 2 then day(dt) = x % 28 + 1 or dayofweek(dt) = 1
  when 3 then day(dt) = 1
  when 4 then dayofweek(dt) between 1 and 5
  when 5 then month(dt) = 2 and day(dt) = 29
  when 7 then month(dt) = 1 and day(dt) in (1, 11, 21, 31)
  else true end),
c_h as (select * exclude (hour_list), unnest(hour_list) hh from c_hits),
c_m as (select * exclude (min_list), unnest(min_list) mm from c_h),
c_s as (select * exclude (sec_list), unnest(sec_list) ss from c_m),
c_t as (select sensor_key, created_seq, (epoch_us(dt) // 1000000 + hh * 3600 + mm * 60 + ss)::bigint es from c_s),
cron as (
  select 'cron' family, es * 268435456 + created_seq seq, es * 1000000 us, '' namespace, '' source, 'cron' "type", '' "version",
    (es * 1000000000)::varchar "data", '' uuid, sensor_key
  from c_t where es > epoch_us(timestamp '{CRON_START}') // 1000000 and es <= epoch_us(timestamp '{CRON_END}') // 1000000)"""


ORACLE["cron_ticks"] = f"""with {SENS}, {cron('sens')} select sensor_key, seq, us ts_us, "type", "data" from cron"""

ALL_FEEDS = ", ".join([KAFKA, MQTT, REDIS, HTTP, K8S, CLOUD, SENS, cron("sens")])
ALL_UNION = " union all ".join(f"select family, {ENV} from {r}" for r in ("kafka", "mqtt", "redis", "http", "k8s", "cloud", "cron"))
ORACLE["union_events"] = f"with {ALL_FEEDS} {ALL_UNION}"
ORACLE["envelope_defaults"] = f"""with {ALL_FEEDS}, u as ({ALL_UNION})
select family, seq, ts_us, namespace, source, "type",
       case when "version" = '' then (ts_us * 1000)::varchar else "version" end "version", "data",
       case when uuid = '' then md5(family || '#' || source || '#' || seq) else uuid end uuid
from u"""

def routes(rel: str) -> str:
    """CTEs with the sensor of every routed event; the last registered wins per key."""
    return f"""rk as (
  select * from (select *, row_number() over (partition by e_type, j % 3, j % 10 order by created_seq desc) rn
    from {rel} where ttype = 'k8s_events' and not meta_empty) where rn = 1),
rc as (
  select * from (select *, row_number() over (partition by j % 20, e_type, j % 4 = 3 order by created_seq desc) rn
    from {rel} where ttype = 'cloud_events' and not meta_empty) where rn = 1),
to_k8s as (select k.*, r.sensor_key from k8s k join rk r on k."type" = r.e_type and k."version" = 'v' || (r.j % 3)
  and k.namespace = 'ns-' || (r.j % 10)),
to_cloud as (select c.*, r.sensor_key from cloud c join rc r on c.source = 'user-' || (r.j % 20) and c."type" = r.e_type
  and c."version" = case when r.j % 4 = 3 then '0.3' else '1.0' end),
to_redis as (select d.*, s.sensor_key from redis d join {rel} s on s.ttype = 'redis' and not s.meta_empty and d.source = 'src' || (s.j % 20)),
to_mqtt as (select m.*, s.sensor_key from mqtt m join {rel} s on s.ttype = 'mqtt' and not s.meta_empty
  and regexp_full_match(m.source, case when s.m_filter = '#' then '.*'
    else regexp_replace(replace(s.m_filter, '+', '[^/]*'), '/#$', '(/.*)?') end))"""


ORACLE["route_k8s"] = f"with {K8S}, {CLOUD}, {REDIS}, {MQTT}, {SENS}, {routes('sens')} select seq, \"type\", namespace, sensor_key from to_k8s"
ORACLE["route_cloud"] = f"with {K8S}, {CLOUD}, {REDIS}, {MQTT}, {SENS}, {routes('sens')} select seq, source, \"type\", \"version\", sensor_key from to_cloud"
ORACLE["route_mqtt"] = f"with {K8S}, {CLOUD}, {REDIS}, {MQTT}, {SENS}, {routes('sens')} select source, seq, sensor_key from to_mqtt"
ORACLE["route_topic"] = f"""with {KAFKA}, {REDIS}, {SENS}
select family, source, seq, sensor_key from kafka join sens on ttype = 'kafka' and not meta_empty and source = k_topic
union all
select family, source, seq, sensor_key from redis join sens on ttype = 'redis' and not meta_empty and source = 'src' || (j % 20)"""
IN_TIME = f"with recursive {HTTP}, {K8S}, {CLOUD}, {SENS}, {generations('sens')}"
ORACLE["route_k8s_asof"] = f"{IN_TIME}, {AT_KEY} select seq, us ts_us, sensor_key, generation from to_k8s"
ORACLE["route_cloud_asof"] = f"{IN_TIME}, {AT_KEY} select seq, us ts_us, sensor_key, generation from to_cloud"
ORACLE["route_host_asof"] = f"{IN_TIME}, {AT_HTTP} select seq, host, us ts_us, sensor_key, generation from to_host"
ORACLE["route_header_asof"] = f"{IN_TIME}, {AT_HTTP} select seq, host, twin, us ts_us, sensor_key, generation from to_header, (select unnest([true, false]) twin)"
ORACLE["route_key"] = f"""with {K8S}, {CLOUD}
select family, seq, "type" || '-' || "version" || '-' || namespace route_key from k8s
union all select family, seq, source || '-' || "type" || '-' || "version" from cloud"""

HTTP_SENS = """hosted as (
  select s.*, unnest(case when a.host is null and b.host is null
    then ['h' || j || '.example.com', 'www.h' || j || '.example.com'] else list_distinct([coalesce(a.host, b.host), coalesce(b.host, a.host)]) end) host
  from sens s left join http a on a.seq = s.x left join http b on b.seq = s.x - 7
  where s.ttype = 'k8s_http' and not s.meta_empty),
winners as (select host, min_by(sensor_key, created_seq) sensor_key from hosted group by host)"""
ORACLE["route_http_host"] = f"""with {HTTP}, {SENS}, {HTTP_SENS}
select seq, host, sensor_key from http join winners using (host) where accepted"""
ORACLE["route_http_header"] = f"""with {HTTP}, {SENS}, {HTTP_SENS},
langs as (select j % 4 lang, min_by(sensor_key, created_seq) sensor_key from sens where ttype = 'k8s_http' and not meta_empty group by 1)
select seq, host, uuid, l.sensor_key from http join langs l using (lang)
where accepted and host not in (select host from winners)"""

ORACLE["validate_sensors"] = f"with {SENS}, {VALID} select sensor_key, error is null \"valid\", error from checked"
ORACLE["list_sensors"] = """select 'ns-' || (s_suppkey % 10) || '/sensor-' || s_suppkey sensor_key, s_suppkey created_seq
from supplier where s_suppkey % 5 between 1 and 3 and s_suppkey % 2 <> 0"""
ORACLE["get_sensor"] = """select 'ns-3/sensor-3' sensor_key, 'ns-3' namespace, 'sensor-3' "name", s_suppkey created_seq from supplier where s_suppkey = 3"""
ORACLE["parse_meta"] = f"""with {SENS}
select sensor_key, ttype "type",
  case when ttype = 'http' then ''
    when meta_empty then case ttype when 'k8s_events' then '|||' when 'cloud_events' then '||' when 'kafka' then '||latest|'
      when 'redis' then '|||0' when 'mqtt' then '||||1' when 'cron' then '' else '||' end
    else case ttype
      when 'k8s_events' then '|' || e_type || '|v' || (j % 3) || '|ns-' || (j % 10)
      when 'cloud_events' then 'user-' || (j % 20) || '|' || e_type || '|' || case when j % 4 = 3 then '0.3' else '1.0' end
      when 'kafka' then 'a;b;c|' || k_topic || '|' || coalesce(k_policy, 'latest') || '|' || k_version
      when 'redis' then '127.0.0.1:6379|default|src' || (j % 20) || '|' || case when r_db = 'x1' then 'bad' else coalesce(r_db, '0') end
      when 'mqtt' then 'tcp://broker:1883|' || m_filter || '|user|' || m_password || '|' || case when j % 9 = 4 then '5' else '1' end
      when 'cron' then c_cron
      else 'h' || j || '.example.com;www.h' || j || '.example.com|x-lang:' || (j % 4) || ';X-Env:e' || j || '|/x' end
  end "options",
  case when target_type <> 'events' then ''
    when not has_target then '|||||'
    else ns || '|v1|Event|Normal|m' || x || '|r' || (x % 3) end "target"
from sens"""
ORACLE["reconcile"] = """
with r as (select s_suppkey x, 'ns-' || (s_suppkey % 10) || '/sensor-' || s_suppkey sensor_key, s_suppkey % 8 = 7 gone,
  s_suppkey % 6 = 0 fresh, s_suppkey % 4 = 0 no_event from supplier)
select sensor_key,
  case when gone then (['', 'other', 'other'])[x % 3 + 1]
       else (['sensor-controller', 'other,sensor-controller', 'other,sensor-controller'])[x % 3 + 1] end finalizers,
  case when gone and fresh then null when gone and no_event then '' when gone then 'e' || x
       when fresh or no_event then md5(sensor_key || '#event') else 'e' || x end event_id,
  case when fresh and gone then null when fresh then '' when x % 5 = 0 then '' else 't' || x end trigger_id
from r"""
ORACLE["is_ready"] = """
select 'ns-' || (s_suppkey % 10) || '/sensor-' || s_suppkey sensor_key,
  s_suppkey % 6 <> 0 and s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0 and s_suppkey % 3 = 0 ready from supplier"""
ORACLE["decode_manifest"] = f"""with {SENS}
select x id, api_version, kind, obj_ns namespace, "name", 'app=a' || (x % 5) || ',tier=t' || (x % 2) "labels",
  'app=a' || (x % 5) match_labels, replicas::int replicas, array_to_string(containers, ',') containers from sens"""
ORACLE["gvr"] = """
select s_suppkey id, (['apps','','','batch'])[s_suppkey % 4 + 1] "group", (['v1','v1','','v1beta1'])[s_suppkey % 4 + 1] "version",
  (['deployments','statefulsets','pods','jobs','policies','ingresses','gateways','namespaces','boxes','shelves','batches','saves'])[s_suppkey % 12 + 1] resource
from supplier"""
ORACLE["maps_equal"] = """
select c_custkey id, c_custkey % 5 <> 4 and (c_custkey % 3 = 0 or c_nationkey = 7) same from customer"""

# change feed

CHANGES = """ch as (
  select 'ns-' || (user_id % 10) || '/s-' || user_id sensor_key,
    case event_type when 'signup' then 'ADD' when 'error' then 'DELETE' else 'UPDATE' end op,
    'spec-' || (regexp_extract(props, '([0-9]+)', 1)::int % 2) spec, event_id // 8 % 2 l, epoch_us(ts) us, event_id seq
  from events),
kept as (
  select * from (select *, lag(op) over w p_op, lag(spec) over w p_spec, lag(l) over w p_l from ch window w as (partition by sensor_key order by us, seq))
  where not (op = 'UPDATE' and p_op is not null and p_op <> 'DELETE' and p_spec = spec and p_l = l)),
gens as (
  select *, (sum((op <> 'DELETE')::int) over w)::bigint generation, lead(us) over w until
  from kept window w as (partition by sensor_key order by us, seq)),
spans as (select sensor_key, generation, spec, us valid_from_us, until valid_to_us from gens where op <> 'DELETE')"""
PROBES = """probe as (
  select event_id seq, epoch_us(ts) + 1800000000 us, 'ns-' || (user_id % 10) || '/s-' || user_id sensor_key
  from events where event_id % 10 < 9),
hits as (
  select p.seq, p.sensor_key, s.generation, p.us, s.valid_from_us from probe p join spans s
  on p.sensor_key = s.sensor_key and p.us >= s.valid_from_us and (s.valid_to_us is null or p.us < s.valid_to_us))"""
ORACLE["registry_noop_filter"] = f"with {CHANGES} select sensor_key, op, spec, us ts_us, seq from kept"
ORACLE["registry_current"] = f"""with {CHANGES}
select sensor_key, spec, us ts_us, seq from (select *, row_number() over (partition by sensor_key order by us desc, seq desc) rn from ch)
where rn = 1 and op <> 'DELETE'"""
ORACLE["registry_intervals"] = f"with {CHANGES} select * from spans"
ORACLE["route_asof"] = f"with {CHANGES}, {PROBES} select seq, sensor_key, generation, us ts_us, valid_from_us from hits"
ORACLE["noop_filter_stream"] = ORACLE["registry_noop_filter"]
ORACLE["route_asof_stream"] = ORACLE["route_asof"]
ORACLE["sensor_state"] = f"""with {CHANGES}, {PROBES}
select s.sensor_key, s.generation, count(h.seq) n_events, coalesce(max(h.us), any_value(s.valid_from_us)) last_ts_us
from spans s left join hits h on s.sensor_key = h.sensor_key and s.generation = h.generation group by 1, 2"""
ORACLE["running_count"] = f"""with {CHANGES}, {PROBES}
select sensor_key, generation, seq, row_number() over (partition by sensor_key, generation order by us, seq) event_count from hits"""
ORACLE["active_roster"] = f"""with {CHANGES},
grid as (select epoch_us(unnest(generate_series(timestamp '{ROSTER_START}', timestamp '{ROSTER_END}', interval 10 minute))) us),
born as (select us, count(*) n from (select unnest([1]) o, valid_from_us us from spans) group by us),
b as (select g.us, (select count(*) from spans where valid_from_us <= g.us) - (select count(*) from spans where valid_to_us <= g.us) active from grid g)
select us ts_us, active from b"""
ORACLE["active_roster_keys"] = f"""with {SENS}, {generations('sens')},
grid as (select unnest(generate_series(timestamp '{ROSTER_START}', timestamp '{ROSTER_END}', interval 1 hour)) ts)
select epoch_us(ts) ts_us, sensor_key from grid join gens on epoch_us(ts) >= a and epoch_us(ts) < b"""

# state

IDLE = """idle as (
  select sensor_key, idle_enabled,
    case when not idle_enabled then 315360000 when try_cast(idle_label as bigint) > 3153600000 then null when try_cast(idle_label as bigint) > 0 then try_cast(idle_label as bigint)
         when try_cast(idle_label as bigint) < 0 then null else 60 end idle_s,
    case when idle_enabled and try_cast(idle_label as bigint) < 0 then 'idle.negative'
         when idle_enabled and try_cast(idle_label as bigint) > 3153600000 then 'idle.too_long' end idle_error
  from sens)"""
ORACLE["idle_config"] = f"with {SENS}, {IDLE} select sensor_key, idle_enabled, idle_s::bigint idle_s, idle_error from idle"

ROUTED = ("to_k8s", "to_cloud", "to_host", "to_header", "to_topic", "to_mqtt", "to_cron")
EVENT = 'family, source, seq, us, namespace, "type", "version", "data"'
FLOW = f"""{KAFKA}, {HTTP}, {K8S}, {CLOUD}, {REDIS}, {MQTT}, {SENS}, {VALID}, {cron('ok')}, {generations('ok')}, {AT_KEY}, {AT_HTTP}, {AT_TOPIC}, {IDLE},
allr as ({" union all ".join(f"select {EVENT}, sensor_key, generation from {r}" for r in ROUTED)}),
routed as (select a.*, ok.* exclude (sensor_key, created_seq, error) from allr a join ok using (sensor_key))"""
FED = " union all ".join(f"select family, source, seq from {r}" for r in ("kafka", "http", "k8s", "cloud", "redis", "mqtt", "cron"))
ORACLE["unrouted"] = f"""with recursive {FLOW}, fed as ({FED})
select family, source, seq from fed f where not exists (select 1 from allr a where a.family = f.family and a.source = f.source and a.seq = f.seq)"""
FIRED = f"""runs as (
  select g.sensor_key, g.generation, a, least(b, epoch_us(timestamp '{HORIZON}')) h, idle_s * 1000000 d
  from gens g join idle using (sensor_key) where idle_error is null),
grid as (select sensor_key, generation, a, d, unnest(range(1, (h - a) // d + 1)) k from runs where h >= a),
seen as (select sensor_key, generation, us from routed),
matched as (
  select g.sensor_key, g.generation, a, d, k, coalesce(e.us, a) + d <= a + k * d fires
  from grid g asof left join seen e on g.sensor_key = e.sensor_key and g.generation = e.generation and g.a + g.k * g.d >= e.us),
marked as (select *, coalesce(lag(fires) over (partition by sensor_key, generation order by k), false) p from matched),
fired as (select sensor_key, generation, a + k * d fire_us, not p first_in_gap from marked where fires)"""
ORACLE["idle_firings"] = f"with recursive {FLOW}, {FIRED} select sensor_key, generation, fire_us fire_ts_us, first_in_gap from fired"

USER_GRID = """with e as (select 'user-' || user_id sensor_key, epoch_us(ts) us from events where {where}),
a as (select epoch_us(timestamp '2024-01-01') a, 21600000000 d),
grid as (select sensor_key, a, d, unnest(range(1, {last} + 1)) k from (select distinct sensor_key from e), a),
matched as (select g.sensor_key, a + k * d t, k, coalesce(e.us, a) + d <= a + k * d fires
  from grid g asof left join e on g.sensor_key = e.sensor_key and g.a + g.k * g.d >= e.us),
marked as (select *, coalesce(lag(fires) over (partition by sensor_key order by k), false) p from matched)"""
ORACLE["idle_firings_users"] = (
    USER_GRID.format(where="event_id % 10 < 9", last="(epoch_us(timestamp '2024-01-31') - a) // d")
    + " select sensor_key, t fire_ts_us, not p first_in_gap from marked where fires"
)
ORACLE["activity_sessions"] = """
with e as (select 'user-' || user_id sensor_key, epoch_us(ts) us from events where event_id % 10 < 9),
g as (select *, coalesce(us - lag(us) over (partition by sensor_key order by us) > 21600000000, true) opens from e),
s as (select *, sum(opens::int) over (partition by sensor_key order by us) n from g)
select sensor_key, min(us) session_start_us, max(us) + 21600000000 session_end_us, count(*) n_events from s group by sensor_key, n"""

# plans

ORACLE["plan_actions"] = f"""with recursive {FLOW}
select family, seq, sensor_key, operation, kind, resource,
  case operation when 'scale' then 'scale_up' when 'create' then 'create' when 'delete' then 'delete' else 'none' end "action",
  case when operation not in ('scale', 'create', 'delete') then 'operation.not_known' end error
from routed"""
PLACED = """placed as (
  select *, case when obj_ns <> '' then obj_ns else coalesce(nullif(first_value(namespace) over (partition by sensor_key, generation order by us, seq, family, source), ''), 'default') end target_namespace
  from routed)"""
ORACLE["resolve_namespace"] = f"with recursive {FLOW}, {PLACED} select family, seq, sensor_key, generation, resource, target_namespace from placed"

UUID = "case when seq % 3 = 0 then 'u-' || seq else '' end"


def labels(uuid: str, prefix: str = "") -> str:
    """Label text in key order; ``prefix`` comes before the event labels."""
    return (
        f"{prefix}'{P}/action-timestamp=' || (us // 1000) || ',{P}/event-data=' || \"data\" || ',{P}/event-namespace=' || namespace"
        f" || ',{P}/event-source=' || source || ',{P}/event-type=' || \"type\" || ',{P}/event-version=' || \"version\""
        f" || case when {uuid} <> '' then ',{P}/pod-uuid=' || {uuid} else '' end"
    )


OBJECT_LABELS = "'app=a' || (x % 5) || ',' || "
TIER = " || ',tier=t' || (x % 2)"
CARRIED = f"""carried as (
  select *, coalesce(last_value(nullif({UUID}, '') ignore nulls) over (partition by sensor_key, generation order by us, seq, family, source rows between unbounded preceding and current row), '') cu
  from placed)"""
ORACLE["event_dict"] = f"with {K8S} select seq, {labels(UUID)} \"labels\" from k8s"
ORACLE["merge_labels"] = f"""with recursive {FLOW}, {PLACED}, {CARRIED}
select family, seq, sensor_key, generation, {labels('cu', OBJECT_LABELS)}{TIER} "labels" from carried"""
ORACLE["event_env"] = f"""with recursive {FLOW}
select family, seq, sensor_key, unnest(containers) container, {labels(UUID)} env from routed where kind in ('Pod', 'Job')"""
ORACLE["plan_create"] = f"""with recursive {FLOW}, {PLACED}, {CARRIED}
select family, seq, sensor_key, generation, resource, target_namespace, "name",
  case when kind in ('Pod', 'Job') then 'typed' else 'generic' end client, {labels('cu', OBJECT_LABELS)}{TIER} "labels",
  len(containers)::int n_containers
from carried where operation = 'create'"""

LIVE = """live as (
  select (['Deployment','StatefulSet','Pod','Job','Policy'])[((s_suppkey // 14 + s_suppkey // 280) % 5)::int + 1] l_kind,
    case when s_suppkey % 10 in (3, 6, 7) then 'elsewhere' else 'ns-' || (s_suppkey % 10) end l_ns,
    'obj-' || s_suppkey l_name, s_suppkey % 3 l_replicas from supplier)"""
ZEROS = """begun as (select sensor_key, generation, min(us) first_us, arg_min(namespace, (us, seq, family, source)) first_ns from routed group by 1, 2),
z as (
  select f.*, o.kind, o."name", o.operation, coalesce(first_us <= fire_us, false) touched,
    case when obj_ns <> '' then obj_ns when first_us <= fire_us and first_ns <> '' then first_ns else 'default' end target_namespace
  from fired f join ok o using (sensor_key) left join begun b on b.sensor_key = f.sensor_key and b.generation = f.generation),
y as (
  select z.*, case when touched and operation in ('create', 'scale') then true when touched and operation = 'delete' then false
    else l_name is not null end present
  from z left join live on kind = l_kind and target_namespace = l_ns and "name" = l_name),
zeros as (
  select sensor_key, generation, fire_us, kind, target_namespace, "name",
    case when kind in ('Deployment', 'StatefulSet') and present then 'patch_zero' else 'none' end "action",
    case when kind not in ('Deployment', 'StatefulSet') or (kind = 'StatefulSet' and not present) then 'error'
         when present then 'ok' else 'noop' end outcome,
    case when kind not in ('Deployment', 'StatefulSet') then 'kind.not_scalable'
         when kind = 'StatefulSet' and not present then 'object.not_found' end error
  from y)"""
LEDGER = f"""{FLOW}, {FIRED}, {PLACED}, {LIVE}, {ZEROS},
looked as (
  select p.*, l_name is not null present, l_replicas,
    lag(us) over (partition by p.sensor_key, p.generation order by us, seq, family, source) prev_us,
    case when operation = 'delete' then row_number() over (partition by operation, kind, target_namespace, "name" order by us, seq, family, source, p.sensor_key, p.generation) end del_no
  from placed p left join live on kind = l_kind and target_namespace = l_ns and "name" = l_name),
firsts as (
  select k.*, (select count(*) from zeros f where f."action" = 'patch_zero' and f.sensor_key = k.sensor_key and f.generation = k.generation
    and f.target_namespace = k.target_namespace and f.fire_us < k.us and f.fire_us > coalesce(k.prev_us, 0)) > 0 woken
  from looked k),
steps as (
  select *, operation = 'scale' and prev_us is null and not present makes,
    case when prev_us is null and not present then coalesce(replicas, 1)
         when woken then 0 when prev_us is null then l_replicas else 1 end cur
  from firsts),
acts as (
  select *, case
      when operation not in ('create', 'delete', 'scale') then 'operation.not_known'
      when operation = 'scale' and kind not in ('StatefulSet', 'Deployment') then 'kind.not_scalable' end error,
    operation = 'scale' and kind in ('StatefulSet', 'Deployment') and cur < 1 patches
  from steps),
ledger as (
  select *, case operation
      when 'create' then 'create'
      when 'delete' then case when del_no = 1 and present then 'delete' else 'none' end
      when 'scale' then case when makes and patches then 'create+patch' when makes then 'create' when patches then 'patch' else 'none' end
      else 'none' end "action" from acts),
done as (select *, case when error is not null then 'error' when "action" = 'none' then 'noop' else 'ok' end outcome from ledger)"""
LEDGER_OUT = 'family, source, seq, sensor_key, generation, operation, resource, target_namespace, "name", "action", outcome, error'
ORACLE["plan_delete"] = f"with recursive {LEDGER} select {LEDGER_OUT} from done where operation = 'delete'"
ORACLE["plan_scale_up"] = f"with recursive {LEDGER} select {LEDGER_OUT} from done where operation = 'scale'"
ORACLE["action_ledger"] = f"with recursive {LEDGER} select {LEDGER_OUT} from done"
ORACLE["ledger_stream"] = ORACLE["action_ledger"]
ORACLE["merge_labels_stream"] = ORACLE["merge_labels"]
ORACLE["cron_tick_stream"] = ORACLE["cron_ticks"]
ORACLE["ledger_summary"] = f"with recursive {LEDGER} select sensor_key, operation, outcome, count(*) n from done group by all"
ORACLE["write_ledger"] = f"""with recursive {LEDGER} select family, seq, sensor_key, generation, "action", outcome,
  strftime(make_timestamp(us), '%Y-%m-%d') "day" from done"""
ORACLE["plan_scale_zero"] = f"""with recursive {FLOW}, {FIRED}, {LIVE}, {ZEROS}
select sensor_key, generation, fire_us fire_ts_us, kind, target_namespace, "name", "action", outcome, error from zeros"""
ORACLE["target_events"] = f"""with recursive {FLOW}
select family, seq, us ts_us, sensor_key, ns target_namespace, 'v1' target_api_version, 'Event' target_kind, 'Normal' target_type,
  'm' || x target_message, 'r' || (x % 3) target_reason
from routed where has_target and target_type = 'events'"""

# endpoints

PODS = """pods as (
  select 'p-' || user_id pod, 'ns-' || (user_id % 10) namespace, user_id, event_id seq, epoch_us(ts) us,
    event_type not in ('signup', 'error') and event_id % 17 <> 0 ready, user_id % 50 = 49 no_address,
    case when user_id % 50 = 49 then null
      else '10.0.0.' || (user_id % 250) || ':' || case when user_id % 4 = 0 then 9000 else 8000 + user_id % 3 end end endpoint
  from events)"""
ORACLE["ready_endpoints"] = f"with {PODS} select seq, pod, ready, endpoint, no_address from pods"
ORACLE["select_pods"] = f"""with {PODS},
u as (select distinct namespace, user_id, pod from pods),
wanted as (
  select distinct 'ns-' || (user_id % 10) namespace, user_id % 5 app, case when event_id % 3 = 0 then null else user_id end only_user from events)
select w.namespace, case when only_user is null then 'app=a' || app else 'app=a' || app || ',user=u' || only_user end selector, u.pod
from wanted w join u on u.namespace = w.namespace and u.user_id % 5 = w.app and (only_user is null or only_user = u.user_id)"""


def endpoint_sql(timeout_s: int) -> str:
    return f"""with {PODS},
states as (select *, coalesce(ready = lag(ready) over (partition by namespace, pod order by us, seq), false) same from pods),
up as (
  select * from (select *, coalesce(lead(us) over (partition by namespace, pod order by us, seq), epoch_us(timestamp '9999-12-31')) until
    from states where not same)
  where ready and until > us),
asks as (select event_id seq, epoch_us(ts) + 420000000 us, 'ns-' || (user_id % 10) namespace, user_id % 5 app,
  case when event_id % 3 = 0 then null else user_id end only_user from events),
cand as (
  select a.seq, p.pod, p.endpoint, greatest(p.us, a.us) ready_us, row_number() over (partition by a.seq order by p.us, p.pod) rn
  from asks a join up p on p.namespace = a.namespace and p.user_id % 5 = a.app and (only_user is null or only_user = p.user_id)
    and p.us <= a.us + {timeout_s}000000 and p.until > a.us)
select a.seq, b.ready_us ready_ts_us, b.pod, b.endpoint, b.pod is not null and b.endpoint is null no_address
from asks a left join cand b on a.seq = b.seq and b.rn = 1"""


ORACLE["resolve_endpoint"] = endpoint_sql(300)
ORACLE["resolve_endpoint_stream"] = ORACLE["resolve_endpoint"]
ORACLE["resolve_endpoint_patient"] = endpoint_sql(172800)

# checks settled by the final watermark: ten minutes before the latest event, in whole milliseconds
ORACLE["idle_stream"] = (
    USER_GRID.format(where="true", last="((select max(us) from e) // 1000 * 1000 - 600000000 - 1 - a) // d")
    + " select sensor_key, 1::bigint generation, t fire_ts_us, not p first_in_gap from marked where fires"
)
