"""ANSI SQL that must give the rows of the registered queries, on the same tables."""

from __future__ import annotations

import re

ASOF = "2021-06-01"

# The inputs and stages as SQL views; a query pulls in the ones it names.
VIEWS = {
    "shop_event": """
        select *, case event_type when 'click' then 'good_detail' when 'view' then 'good_list'
                    when 'signup' then 'home' when 'purchase' then 'cart' else '' end page_id,
               json_extract_string(props, '$.k') item from events""",
    "page_log": """
        select event_id, concat('m', cast(user_id as varchar)) mid, ts, page_id,
               case when prev_ts is not null and ts < prev_ts + interval 6 hour then prev_page end last_page_id,
               item, cast(round(value*100) as bigint)*10 during_time,
               concat('v', cast(user_id%3 as varchar)) vc, concat('c', cast(user_id%5 as varchar)) ch,
               concat('a', cast(user_id%7 as varchar)) ar,
               case when event_id%2=0 then '1' else '0' end is_new
        from (select e.*, lag(ts) over (partition by user_id order by ts, event_id) prev_ts,
                     lag(page_id) over (partition by user_id order by ts, event_id) prev_page
              from shop_event e) w""",
    "display_log": """
        select event_id, ts, cast((cast(item as bigint)+i)%100 as varchar) item,
               case when (event_id+i)%2=0 then 'sku_id' else 'activity_id' end item_type
        from (select *, unnest(range(0, event_id%3+1)) i from shop_event where page_id='good_list') d""",
    "search_log": """
        select e.event_id, e.ts, p_name fullword from shop_event e
        left join part on p_partkey = cast(e.item as bigint) where e.page_id='good_list'""",
    "order_info": """
        select o_orderkey id, o_custkey user_id, cast(c_nationkey as bigint) province_id,
               o_orderstatus order_status, cast(o_totalprice as decimal(16,2)) total_amount,
               o_orderdate + to_seconds(o_orderkey%86400) create_time
        from orders left join customer on o_custkey=c_custkey""",
    "order_detail": """
        select l_orderkey*10+l_linenumber id, l_orderkey order_id, l_partkey sku_id,
               cast(l_extendedprice as decimal(16,2)) order_price, cast(l_quantity as bigint) sku_num,
               cast(l_extendedprice as decimal(16,2))*(1-cast(l_discount as decimal(4,2))) split_total_amount,
               cast(l_extendedprice as decimal(16,2))*cast(l_discount as decimal(4,2)) split_coupon_amount,
               o.create_time + to_seconds(l_linenumber*2-5) create_time, l_returnflag, l_linestatus, l_linenumber
        from lineitem join order_info o on o.id=l_orderkey""",
    "payment_info": """
        select id, id order_id, user_id, total_amount, cast(1101+id%3 as varchar) payment_type,
               create_time + to_seconds(id%2400) create_time,
               create_time + to_seconds(id%2400+5) callback_time
        from order_info where order_status<>'O'""",
    "favor_info": "select cast(item as bigint) sku_id, ts create_time from shop_event where page_id='home'",
    "cart_info": "select cast(item as bigint) sku_id, ts create_time from shop_event where page_id='cart'",
    "refund_info": """
        select sku_id, order_id, order_price refund_amount, create_time
        from order_detail where l_returnflag='R'""",
    "comment_info": """
        select sku_id, cast(1201+l_linenumber%4 as varchar) appraise, create_time
        from order_detail where l_linestatus='F'""",
    "dim_user": """
        select c_custkey id, date '1950-01-01' + cast(c_custkey%18000 as int) birthday,
               case when c_custkey%2=0 then 'M' else 'F' end gender from customer""",
    "dim_province": """
        select cast(n_nationkey as bigint) id, n_name as name, cast(n_regionkey as varchar) area_code,
               concat('P', cast(n_nationkey as varchar)) iso_code,
               concat('CN-', cast(n_nationkey as varchar)) iso_3166_2
        from nation""",
    "products": """
        select p_partkey id, p_name sku_name, cast(p_retailprice as decimal(16,2)) price,
               min(p_partkey) over (partition by p_name) spu_id, p_name spu_name,
               cast(substring(p_brand, 7) as bigint) tm_id, p_brand tm_name,
               min(p_partkey) over (partition by p_type) category3_id, p_type category3_name
        from part""",
    "changes": """
        select 1 seq, 'insert' as type, c_custkey id, c_name as name from customer
        union all select 2, 'update', c_custkey, concat(c_name,'x') from customer where c_custkey%5=0
        union all select 3, 'delete', c_custkey, c_name from customer where c_custkey%50=0""",
    "captured": """
        select 1 seq, 'user_info' tbl, 'insert' as type, cast(c_custkey as varchar) id, c_name as name,
               cast(c_custkey%7 as varchar) as level, cast(null as varchar) status, 3 fields from customer
        union all select 2, 'user_info', 'update', cast(c_custkey as varchar), concat(c_name,'x'), null, null, 2
               from customer where c_custkey%5=0
        union all select 3, 'user_info', 'delete', null, null, null, null, 0 from customer where c_custkey%50=0
        union all select 1, 'order_info', 'insert', cast(o_orderkey as varchar), null, null, o_orderstatus, 2 from orders
        union all select 1, 'base_province', 'insert', cast(n_nationkey as varchar), n_name, null, null, 2 from nation""",
    "order_merge": """
        select d.id detail_id, o.id order_id, d.sku_id, d.order_price, d.sku_num, o.province_id,
               o.order_status, o.user_id, o.total_amount, o.total_amount original_total_amount,
               d.split_coupon_amount, d.split_total_amount,
               o.create_time, d.create_time line_time
        from order_info o join order_detail d on o.id=d.order_id
         and d.create_time >= o.create_time - interval 5 second
         and d.create_time <= o.create_time + interval 5 second""",
    "order_full": f"""
        select w.*, strftime(w.create_time, '%Y-%m-%d') create_date, strftime(w.create_time, '%H') create_hour,
               u.gender user_gender,
               cast(year(date '{ASOF}') - year(u.birthday)
                    - case when strftime(date '{ASOF}', '%m%d') < strftime(u.birthday, '%m%d') then 1 else 0 end
                    as bigint) user_age,
               v.name province_name, v.area_code province_area_code, v.iso_code province_iso_code,
               v.iso_3166_2 province_3166_2_code, p.sku_name, p.spu_id, p.spu_name, p.tm_id, p.tm_name,
               p.category3_id, p.category3_name
        from order_merge w left join dim_user u on u.id=w.user_id
        left join dim_province v on v.id=w.province_id left join products p on p.id=w.sku_id""",
    "paid": """
        select p.id payment_id, p.payment_type, p.create_time payment_create_time, p.callback_time,
               p.user_id, p.total_amount, w.detail_id, w.order_id, w.sku_id, w.sku_num,
               w.split_total_amount, w.create_time order_create_time, w.order_status, w.province_id
        from payment_info p join order_merge w on p.order_id=w.order_id
         and w.create_time >= p.callback_time - interval 1800 second
         and w.create_time <= p.callback_time""",
    "paid_full": """
        select p.*, w.create_time create_time_1, w.* exclude (order_id, user_id, total_amount, create_time)
        from payment_info p join order_full w on p.order_id=w.order_id
         and w.create_time >= p.callback_time - interval 1800 second
         and w.create_time <= p.callback_time""",
    "first_opening": """
        select * from (
          select *, row_number() over (partition by mid, cast(ts as date) order by ts, event_id) rn
          from page_log where coalesce(last_page_id,'')='') x where rn=1""",
    "opening": """
        select * from (
          select *, lead(ts) over (partition by mid order by ts, event_id) next_ts,
                 lead(page_id) over (partition by mid order by ts, event_id) next_page
          from page_log) x where coalesce(last_page_id,'')=''""",
    "jump": "select * from opening where next_ts is null or next_ts >= ts + interval 10 second",
    "visitor_event": """
        select vc, ch, ar, is_new, 0 uv, 1 pv, case when coalesce(last_page_id,'')='' then 1 else 0 end sv,
               0 uj, during_time dur, ts from page_log
        union all select vc, ch, ar, is_new, 1, 0, 0, 0, 0, ts from first_opening
        union all select vc, ch, ar, is_new, 0, 0, 0, 1, 0, ts from jump""",
    "visitor_window": """
        select time_bucket(interval 10 second, ts) w, vc, ch, ar, is_new, cast(sum(uv) as bigint) uv_ct,
               cast(sum(pv) as bigint) pv_ct, cast(sum(sv) as bigint) sv_ct, cast(sum(uj) as bigint) uj_ct,
               cast(sum(dur) as bigint) dur_sum, epoch_us(min(ts))//1000 ts
        from visitor_event group by all""",
    "behaviour": """
        select cast(item as bigint) sku_id, ts, 'click' kind, null::bigint oid, 0::decimal(18,4) amt, 0 qty
          from shop_event where page_id='good_detail'
        union all select cast(item as bigint), ts, 'display', null, 0, 0 from display_log where item_type='sku_id'
        union all select sku_id, create_time, 'favor', null, 0, 0 from favor_info
        union all select sku_id, create_time, 'cart', null, 0, 0 from cart_info
        union all select sku_id, create_time, 'order', order_id, split_total_amount, sku_num from order_merge
        union all select sku_id, payment_create_time, 'pay', order_id, split_total_amount, 0 from paid
        union all select sku_id, create_time, 'refund', order_id, refund_amount, 0 from refund_info
        union all select sku_id, create_time, case when appraise='1201' then 'good' else 'comment' end, null, 0, 0
          from comment_info""",
    "product_window": """
        select time_bucket(interval 10 second, ts) w, sku_id,
               count(*) filter (kind='display') display_ct, count(*) filter (kind='click') click_ct,
               count(*) filter (kind='favor') favor_ct, count(*) filter (kind='cart') cart_ct,
               cast(sum(qty) as bigint) order_sku_num,
               cast(coalesce(sum(amt) filter (kind='order'),0) as decimal(28,4)) order_amount,
               count(distinct oid) filter (kind='order') order_ct,
               cast(coalesce(sum(amt) filter (kind='pay'),0) as decimal(28,4)) payment_amount,
               count(distinct oid) filter (kind='pay') paid_order_ct,
               count(distinct oid) filter (kind='refund') refund_order_ct,
               cast(coalesce(sum(amt) filter (kind='refund'),0) as decimal(28,4)) refund_amount,
               count(*) filter (kind in ('comment','good')) comment_ct,
               count(*) filter (kind='good') good_comment_ct, epoch_us(min(ts))//1000 ts
        from behaviour group by all""",
    "product_full": """
        select strftime(w,'%Y-%m-%d %H:%M:%S') stt, strftime(w + interval 10 second,'%Y-%m-%d %H:%M:%S') edt,
               s.* exclude (w), p.sku_name, p.price sku_price, p.spu_id, p.spu_name, p.tm_id, p.tm_name,
               p.category3_id, p.category3_name, cast(strftime(w,'%Y%m%d') as int) dt
        from product_window s left join products p on p.id=s.sku_id""",
    "province_window": """
        select time_bucket(interval 10 second, create_time) w, province_id, province_name,
               province_area_code area_code, province_iso_code iso_code, province_3166_2_code iso_3166_2,
               cast(sum(split_total_amount) as decimal(28,4)) order_amount,
               count(distinct order_id) order_count
        from order_full group by all""",
    "search_keyword": """
        select unnest(regexp_extract_all(lower(fullword), '[\\p{L}\\p{N}]+')) keyword, ts from search_log""",
    "search_window": """
        select keyword, count(*) ct, 'SEARCH' source, time_bucket(interval 10 second, ts) w
        from search_keyword group by all""",
    "product_keyword": """
        select keyword, ct, source, stt, edt from (
          select unnest(regexp_extract_all(lower(spu_name), '[\\p{L}\\p{N}]+')) keyword, * from product_full) k,
          lateral (select click_ct ct, 'CLICK' source union all select cart_ct, 'CART'
                   union all select order_ct, 'ORDER') c where ct > 0""",
    "keyword_all": """
        select keyword, ct, source, strftime(w,'%Y-%m-%d %H:%M:%S') stt from search_window
        union all select keyword, ct, source, stt from product_keyword""",
}

BOUNDS = """strftime(w,'%Y-%m-%d %H:%M:%S') stt, strftime(w + interval 10 second,'%Y-%m-%d %H:%M:%S') edt"""
SECOND = "'%Y-%m-%d %H:%M:%S'"


def _needed(text: str) -> list[str]:
    seen: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b(from|join|,)\s+{name}\b", sql):
                visit(VIEWS[name])
                if name not in seen:
                    seen.append(name)

    visit(text)
    return seen


def with_views(text: str) -> str:
    needed = _needed(text)
    if not needed:
        return text
    views = "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)
    own = re.match(r"\s*with\b", text)
    return f"{views},\n{text[own.end():]}" if own else f"{views}\n{text}"


def _ranked(keys: str, more: str = "") -> str:
    cols = ", ".join(keys.split())
    return f"""select dt, {cols}, order_amount{', order_ct' if more else ''} from (
        select *, row_number() over (partition by dt order by order_amount desc, {cols}) rn from (
          select dt, {cols}, cast(sum(order_amount) as decimal(38,4)) order_amount
                 {', cast(sum(order_ct) as bigint) order_ct' if more else ''}
          from product_full group by all having sum(order_amount) > 0) s) r where rn <= 20"""


VISITOR_DAY = f"""
    select cast(strftime(w,'%Y%m%d') as int) dt, is_new, cast(sum(uv_ct) as bigint) uv_ct,
           cast(sum(pv_ct) as bigint) pv_ct, cast(sum(sv_ct) as bigint) sv_ct,
           cast(sum(uj_ct) as bigint) uj_ct, cast(sum(dur_sum) as bigint) dur_sum
    from visitor_window group by all"""


def _half_up(num: str, den: str, scale: int) -> str:
    return f"cast((2*({num})*{10 ** scale} + {den}) // (2*{den}) as decimal(18,0)) * cast({10 ** -scale:.{scale}f} as decimal(4,{scale}))"


def _ratio_columns(p: str = "") -> dict[str, str]:
    sv = f"case when {p}sv_ct=0 then 1 else {p}sv_ct end"
    ok = f"{p}uv_ct<>0 and {p}sv_ct<>0"
    dur = f"(2*{p}dur_sum + ({sv})) // (2*({sv}))"
    return {"uj_rate": f"cast(case when {ok} then {_half_up(f'{p}uj_ct*100', f'({sv})', 2)} else 0 end as decimal(18,2))",
            "dur_per_sv": f"cast(case when {ok} then {_half_up(dur, '1000', 1)} else 0 end as decimal(18,1))",
            "pv_per_sv": f"cast(case when {ok} then {_half_up(f'{p}pv_ct', f'({sv})', 2)} else 0 end as decimal(18,2))"}


def _matrix() -> str:
    names = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
    sums = ", ".join(f"coalesce(sum({c}) filter ({cond}),0)::bigint {side}{c}"
                     for side, cond in (("new_", "is_new='1'"), ("old_", "is_new<>'1'")) for c in names)
    new, old = _ratio_columns("new_"), _ratio_columns("old_")
    rows = [("uv", "new_uv_ct", "old_uv_ct"), ("pv", "new_pv_ct", "old_pv_ct"),
            *[(k, new[k], old[k]) for k in new]]
    day = f"select dt, {sums} from ({VISITOR_DAY}) d group by dt"
    return " union all ".join(
        f"select dt, '{k}' as type, cast({a} as decimal(20,2)) as new, cast({b} as decimal(20,2)) as old from ({day}) m"
        for k, a, b in rows)


ZERO = "cast(0 as decimal(18,4))"
AMOUNTS = f"""{ZERO} activity_reduce_amount, {ZERO} coupon_reduce_amount, {ZERO} feight_fee,
               cast(original_total_amount as decimal(18,4)) original_total_amount,
               cast(split_total_amount as decimal(18,4)) split_total_amount, {ZERO} split_activity_amount,
               cast(split_coupon_amount as decimal(18,4)) split_coupon_amount,
               cast(null as varchar) expire_time, cast(null as varchar) operate_time"""

QUERIES = {
    # ---- dashboard -------------------------------------------------------------------------
    "gmv_by_day": "select dt, cast(sum(order_amount) as decimal(38,4)) order_amount from product_full group by dt",
    "top_brands": _ranked("tm_id tm_name"),
    "top_categories": _ranked("category3_id category3_name"),
    "top_spus": _ranked("spu_id spu_name", "order_ct"),
    "province_sales": """
        select cast(strftime(w,'%Y%m%d') as int) dt, province_id, province_name,
               cast(sum(order_amount) as decimal(38,4)) order_amount from province_window group by all""",
    "visitor_matrix": _matrix(),
    "visitors_by_hour": """
        select d.dt, h.hr, coalesce(uv_ct,0) uv_ct, coalesce(pv_ct,0) pv_ct, coalesce(new_uv,0) new_uv
        from (select distinct cast(strftime(w,'%Y%m%d') as int) dt from visitor_window) d
        cross join (select lpad(cast(i as varchar),2,'0') hr from range(24) t(i)) h
        left join (select cast(strftime(w,'%Y%m%d') as int) dt, strftime(w,'%H') hr,
                     cast(sum(uv_ct) as bigint) uv_ct, cast(sum(pv_ct) as bigint) pv_ct,
                     cast(sum(case when is_new='1' then uv_ct else 0 end) as bigint) new_uv
              from visitor_window group by all) s on s.dt=d.dt and s.hr=h.hr""",
    "hot_keywords": """
        select dt, keyword, ct from (
          select *, row_number() over (partition by dt order by plain desc, keyword) rn from (
            select cast(replace(substring(stt,1,10),'-','') as int) dt, keyword, cast(sum(ct) as bigint) plain,
                   cast(sum(ct * case source when 'SEARCH' then 10 when 'ORDER' then 3 when 'CART' then 2
                                 when 'CLICK' then 1 else 0 end) as bigint) ct
            from keyword_all group by 1, 2) s) r where rn <= 20""",
    "pv_uv_by_day": """
        select cast(strftime(w,'%Y%m%d') as int) dt, cast(sum(pv_ct) as bigint) pv_ct,
               cast(sum(uv_ct) as bigint) uv_ct from visitor_window group by 1""",
    "pv_uv_rows_by_day": """
        select cast(strftime(w,'%Y%m%d') as int) dt, count(pv_ct) pv_ct, count(uv_ct) uv_ct
        from visitor_window group by 1""",
    "visit_ratios": f"select *, {', '.join(f'{v} {k}' for k, v in _ratio_columns().items())} from ({VISITOR_DAY}) d",
    # ---- joins -----------------------------------------------------------------------------
    "order_wide": f"""
        select detail_id, order_id, sku_id, order_price, sku_num, sku_name, province_id, order_status, user_id,
               total_amount, {AMOUNTS}, strftime(create_time,{SECOND}) create_time, create_date, create_hour, user_gender, user_age,
               province_name, province_area_code, province_iso_code, province_3166_2_code, spu_id, spu_name,
               tm_id, tm_name, category3_id, category3_name from order_full""",
    "payment_wide": f"""
        select id payment_id, cast(null as varchar) subject, payment_type,
               strftime(create_time,{SECOND}) payment_create_time, strftime(callback_time,{SECOND}) callback_time,
               user_id, total_amount, detail_id, order_id, sku_id, order_price, sku_num, {AMOUNTS},
               strftime(create_time_1,{SECOND}) order_create_time, order_status, province_id, user_gender, user_age,
               province_name, province_area_code, province_iso_code, province_3166_2_code, sku_name, spu_id,
               spu_name, tm_id, tm_name, category3_id, category3_name from paid_full""",
    "order_detail_interval_edges": """
        select cast(d.l_linenumber*2-5 as bigint) gap, count(*) line_ct, count(w.detail_id) joined_ct
        from order_detail d left join (select distinct detail_id, order_id from order_merge) w
          on w.detail_id=d.id and w.order_id=d.order_id group by 1""",
    "enrich_user": f"""
        select id, user_id, gender user_gender, user_age from (
          select o.id, o.user_id, u.gender, cast(year(date '{ASOF}') - year(u.birthday)
               - case when strftime(date '{ASOF}', '%m%d') < strftime(u.birthday, '%m%d') then 1 else 0 end
               as bigint) user_age
          from order_info o left join dim_user u on u.id=o.user_id) x""",
    "enrich_province": """
        select o.id, o.province_id, v.name province_name, v.area_code province_area_code,
               v.iso_code province_iso_code, v.iso_3166_2 province_3166_2_code
        from order_info o left join dim_province v on v.id=o.province_id""",
    "enrich_product": """
        select d.order_id, d.sku_id, d.sku_num, p.sku_name, p.price sku_price, p.spu_id, p.spu_name, p.tm_id,
               p.tm_name, p.category3_id, p.category3_name
        from order_detail d left join products p on p.id=d.sku_id""",
    "product_dim": """
        select id, sku_name, price, spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
        from products""",
    "lookup_rows": """
        select id, sku_name, tm_name, category3_name from products
        where tm_name='Brand#2' and category3_name='ECONOMY'""",
    "coalesce_rows": """
        select o.id, coalesce(case when o.id%3<>0 then o.total_amount end, p.total_amount) total_amount,
               o.user_id from order_info o left join payment_info p on p.order_id=o.id""",
    # ---- log -------------------------------------------------------------------------------
    "parse_json": """
        select mid, page_id, last_page_id, item, during_time, epoch_us(ts)//1000 ts from page_log
        union all select mid, null, null, null, null, epoch_us(ts)//1000 from page_log where page_id='home'""",
    "split_logs": """
        select 'page' kind, mid, page_id, last_page_id, item, null item_type, during_time, epoch_us(ts)//1000 ts
        from page_log
        union all select 'start', mid, null, null, null, null, null, epoch_us(ts)//1000 from page_log where page_id='home'
        union all select 'display', null, 'good_list', null, item, item_type, null, null from display_log""",
    "explode_displays": "select 'good_list' page_id, item, item_type from display_log",
    "repair_is_new": f"""
        select event_id, mid, case when is_new='1' and cast(ts as date) <>
                 min(case when is_new='1' then cast(ts as date) end) over (partition by mid)
               then '0' else is_new end is_new from page_log""",
    "to_json_rows": "select cast(event_id as varchar) event_id, mid, page_id, last_page_id from page_log",
    "unique_visits": f"select event_id, mid, strftime(ts,'%Y%m%d') visit_day from first_opening",
    "user_jumps": "select event_id, mid, page_id from jump",
    "user_jumps_hour": """
        select event_id, mid, page_id from opening
        where next_ts is null or next_ts >= ts + interval 3600 second""",
    "opening_outcomes": """
        select event_id, case when next_ts is null or next_ts >= ts + interval 3600 second then 'bounce'
                    when coalesce(next_page,'')<>'' then 'match' else 'broken' end outcome from opening""",
    "search_terms": "select item fullword, count(*) ct from shop_event where page_id='good_list' and item is not null group by 1",
    "tokenize": """
        select word, count(*) ct from (
          select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) word from documents) t group by 1""",
    "unpivot_counts": """
        select sku_id, stt, source, ct from product_full, lateral (
          select click_ct ct, 'CLICK' source union all select cart_ct, 'CART'
          union all select order_ct, 'ORDER') c where ct > 0""",
    # ---- measures --------------------------------------------------------------------------
    "product_clicks": "select cast(item as bigint) sku_id, cast(1 as bigint) click_ct, epoch_us(ts)//1000 ts from shop_event where page_id='good_detail'",
    "product_displays": "select cast(item as bigint) sku_id, cast(1 as bigint) display_ct, epoch_us(ts)//1000 ts from display_log where item_type='sku_id'",
    "product_favors": "select sku_id, cast(1 as bigint) favor_ct, epoch_us(create_time)//1000 ts from favor_info",
    "product_carts": "select sku_id, cast(1 as bigint) cart_ct, epoch_us(create_time)//1000 ts from cart_info",
    "product_orders": """
        select sku_id, sku_num order_sku_num, cast(split_total_amount as decimal(18,4)) order_amount, order_id,
               epoch_us(create_time)//1000 ts from order_merge""",
    "product_payments": """
        select sku_id, cast(split_total_amount as decimal(18,4)) payment_amount, order_id paid_order_id,
               epoch_us(payment_create_time)//1000 ts from paid""",
    "product_refunds": """
        select sku_id, cast(refund_amount as decimal(18,4)) refund_amount, order_id refund_order_id,
               epoch_us(create_time)//1000 ts from refund_info""",
    "product_comments": """
        select sku_id, cast(1 as bigint) comment_ct,
               cast(case when appraise='1201' then 1 else 0 end as bigint) good_comment_ct,
               epoch_us(create_time)//1000 ts from comment_info""",
    "visitor_events": """
        select vc, ch, ar, is_new, cast(uv as bigint) uv_ct, cast(pv as bigint) pv_ct, cast(sv as bigint) sv_ct,
               cast(uj as bigint) uj_ct, cast(dur as bigint) dur_sum, epoch_us(ts)//1000 ts from visitor_event""",
    # ---- statistics ------------------------------------------------------------------------
    "visitor_stats": f"select {BOUNDS}, * exclude (w) from visitor_window",
    "product_stats": "select * exclude (dt) from product_full",
    "province_stats": f"select {BOUNDS}, * exclude (w) from province_window",
    "keyword_search_stats": f"select keyword, ct, source, {BOUNDS} from search_window",
    "keyword_product_stats": "select keyword, ct, source, stt, edt from product_keyword",
    "distinct_orders": "select sku_id, count(distinct order_id) distinct_ct from order_detail group by 1",
    "tumble_counts": f"""
        select {BOUNDS}, page_id, ct from (
          select time_bucket(interval 10 second, ts) w, page_id, count(*) ct from page_log group by all) x""",
    # ---- change data -----------------------------------------------------------------------
    "normalize_change": """
        select cast(seq as bigint) seq, 'shop' as database, tbl as "table", type, id, name, level, status,
               cast(fields as bigint) fields from captured""",
    "normalize_change_raw": """
        select cast(seq as bigint) seq, tbl as "table", id,
               case when type='insert' and tbl<>'base_province' then 'create' else type end as operation
        from captured""",
    "valid_changes": """
        select cast(seq as bigint) seq, tbl as "table", type, id from captured where fields>0""",
    "route_changes": """
        select tbl as "table", type, case tbl when 'user_info' then 'dim_user_info' else 'dwd_order_info' end sink_table,
               id, name, status, cast(2 as bigint) fields
        from captured where fields>0 and tbl in ('user_info','order_info')""",
    "unrouted_changes": """
        select tbl as "table", type, id from captured where fields>0 and tbl not in ('user_info','order_info')""",
    "split_routes": """
        select case tbl when 'user_info' then 'dim' else 'fact' end side,
               case tbl when 'user_info' then 'dim_user_info' else 'dwd_order_info' end sink_table,
               cast(seq as bigint) seq, id
        from captured where fields>0 and tbl in ('user_info','order_info')""",
    "current_users": """
        select cast(c_custkey as varchar) id, concat(c_name, case when c_custkey%5=0 then 'x' else '' end) as name
        from customer where c_custkey%50<>0""",
    "routes_from_changes": """
        select n_name source_table, concat(case when n_nationkey%3=0 then 'ods_' else 'dwd_' end,
               cast(n_nationkey as varchar)) sink_table from nation where n_nationkey%5<>0""",
    "quarantined_changes": """
        select cast(4 as bigint) seq, concat('{"after":{"id":', cast(c_custkey as varchar)) line
        from customer where c_custkey%40=1""",
    "quarantined_lines": """
        select concat('{"common":{"mid":"m', cast(user_id as varchar)) line from events where event_id%50=3""",
    "latest_by_key": """
        select id, name, type from (
          select *, row_number() over (partition by id order by seq desc) rn from changes) x
        where rn=1 and type<>'delete'""",
    "latest_by_key_keep": """
        select id, name, type from (
          select *, row_number() over (partition by id order by seq desc) rn from changes) x where rn=1""",
    "upsert_by_key": """
        select cast(c_custkey as varchar) id, concat(c_name, case when c_custkey%5=0 then 'x' else '' end) as name,
               cast(c_custkey%7 as varchar) as level from customer""",
}

QUERIES |= {
    "sql_keyword_search_stats": QUERIES["keyword_search_stats"],
    "sql_keyword_product_stats": QUERIES["keyword_product_stats"],
    "sql_province_stats": QUERIES["province_stats"],
    "with_event_time": f"select event_id, strftime(date_trunc('second', ts),{SECOND}) rowtime from shop_event",
    "payment_type_labels": """
        select payment_type, case payment_type when '1101' then 'alipay' when '1102' then 'wechat'
                             else 'unionpay' end as label, count(*) ct from payment_info group by all""",
}

SALES_DAY = "(select cast(strftime(min(o_orderdate),'%Y%m%d') as int) from orders)"
VISIT_DAY = "(select cast(strftime(min(ts),'%Y%m%d') as int) from events)"
for _name, _columns, _day in (("gmv_by_day", "order_amount", SALES_DAY), ("top_brands", "*", SALES_DAY),
                              ("top_categories", "*", SALES_DAY), ("top_spus", "*", SALES_DAY),
                              ("province_sales", "*", SALES_DAY), ("visitor_matrix", "* exclude (dt)", VISIT_DAY),
                              ("pv_uv_by_day", "pv_ct, uv_ct", VISIT_DAY), ("pv_uv_rows_by_day", "pv_ct, uv_ct", VISIT_DAY),
                              ("visitors_by_hour", "* exclude (dt)", VISIT_DAY), ("hot_keywords", "*", VISIT_DAY)):
    QUERIES[f"{_name.removesuffix('_by_day')}_one_day"] = \
        f"select {_columns} from ({QUERIES[_name]}) every_day where dt = {_day}"
QUERIES |= {"sink_visitor_stats": QUERIES["visitor_stats"], "sink_product_stats": QUERIES["product_stats"],
            "sink_province_stats": QUERIES["province_stats"],
            "sink_keyword_stats": f"{QUERIES['keyword_search_stats']} union all {QUERIES['keyword_product_stats']}"}

# The stream runs must end with the rows of the batch operators.
for _batch in ("unique_visits", "user_jumps", "repair_is_new", "order_wide", "payment_wide",
               "visitor_stats", "province_stats", "keyword_search_stats", "product_stats"):
    QUERIES[f"stream_{_batch}"] = QUERIES[_batch]
QUERIES["stream_unique_visits_late"] = QUERIES["unique_visits"]
QUERIES["stream_dim_table"] = """
    select cast(c_custkey as varchar) id, concat(c_name, case when c_custkey%5=0 then 'x' else '' end) as name
    from customer"""
QUERIES["stream_route_changes"] = QUERIES["route_changes"]


# Dimension rows changed before the second step: users and provinces of lines that met in it are new.
_MET_LATE = """epoch_us(greatest(create_time, line_time)) * 2 >= (
    select epoch_us(least(min(a.f), min(b.f))) + epoch_us(greatest(max(a.l), max(b.l)))
    from (select min(create_time) f, max(create_time) l from order_info) a,
         (select min(create_time) f, max(create_time) l from order_detail) b)"""
QUERIES["stream_order_wide"] = QUERIES["order_wide"].replace("user_gender, user_age", f"""
    case when user_id % 10 = 0 and {_MET_LATE} then 'X' else user_gender end user_gender, user_age""").replace(
    "province_name, province_area_code", f"""
    case when province_id % 5 = 0 and {_MET_LATE} then concat(province_name, ' 2') else province_name end province_name,
    province_area_code""")
_USER_LOG = """
    select 1000000000 + c_custkey seq, 'insert' as type, c_custkey id, c_name as name, null before_name from customer
    union all select 2000000000 + c_custkey, 'update', c_custkey, concat(c_name,'x'), c_name from customer where c_custkey%5=0
    union all select 3000000000 + c_custkey, 'delete', c_custkey, null, concat(c_name,'x') from customer where c_custkey%50=0"""
_CUT = "(select 2000000000 + max(c_custkey) // 2 from customer)"
_LATE_ROUND = "least(2, (epoch_us(arrives) - epoch_us(f)) * 3 // (epoch_us(l) - epoch_us(f)))"
QUERIES |= {
    "distinct_orders_of_day": """
        select cast(strftime(create_time,'%Y%m%d') as int) dt, count(distinct order_id) distinct_ct
        from order_merge group by 1""",
    "parse_time": f"""
        select id, case when id%7<>0 then epoch_us(create_time)//1000 end ms,
               case when id%7<>0 then strftime(create_time + interval 1 second,{SECOND}) end later from order_info""",
    "json_topic": """
        select event_id, mid, page_id, during_time from page_log
        union all select null, concat('{"common":{"mid":"m', cast(user_id as varchar)), null, null
        from events where event_id%50=3""",
    "stream_keyword_product_stats": QUERIES["keyword_product_stats"],
    "sink_visitor_stats_closed": f"select * from ({QUERIES['visitor_stats']}) every_day where substring(stt,1,10) = (select strftime(min(ts),'%Y-%m-%d') from events)",
    "stream_visitor_chain": QUERIES["visitor_stats"],
    "stream_sql_keyword": QUERIES["keyword_search_stats"],
    "stream_sql_province": QUERIES["province_stats"],
    "stream_raw_lines": "select props as value, strftime(ts, '%Y-%m-%d') dt from events",
    "stream_late_rows": f"""
        with pages as (
          select event_id, ts, case when mid like '%7' then ts + interval 2 day else ts end arrives from page_log),
        bounds as (select min(arrives) f, max(arrives) l from pages),
        dealt as (select event_id, ts, {_LATE_ROUND} as step from pages, bounds),
        newest as (select step, max(ts) as newest from dealt group by step)
        select d.event_id, case when d.ts < (select max(n.newest) from newest n where n.step < d.step) - interval 3 second
                                then 'true' else 'false' end as late
        from dealt d""",
    "stream_topics": """
        select case tbl when 'user_info' then 'dim_user_info' else 'dwd_order_info' end topic, id, name, status
        from captured where fields>0 and tbl in ('user_info','order_info')""",
    "stream_snapshot_then_log": f"""
        select {_CUT}::bigint seq, 'read' as type, cast(c_custkey as varchar) id,
               case when c_custkey%5=0 and 2000000000 + c_custkey <= {_CUT} then concat(c_name,'x') else c_name end as name
        from customer
        union all select seq::bigint, type, cast(id as varchar), coalesce(name, before_name)
        from ({_USER_LOG}) u where seq > {_CUT}""",
    "stream_user_changes": f"""
        select kind, cast(id as varchar) id, v as name, seq::bigint seq from ({_USER_LOG}) u, lateral (
          select '+I' kind, name v where type = 'insert' union all select '-U', before_name where type = 'update'
          union all select '+U', name where type = 'update' union all select '-D', before_name where type = 'delete') k""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in QUERIES.items()}
