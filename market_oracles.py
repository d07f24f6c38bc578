"""SQL that states what each query of ``market_queries`` must return.

Reports are written branch by branch: a scan per area, date and grain, medians as window
functions, then distinct and joins. The library takes other routes to the same rows.
"""

from __future__ import annotations

from market_sample import as_sql
from parcelwise.functions import constants as K

import market_queries as Q

CY_END, PY_END = "date '2000-06-30'", "date '1999-06-30'"
EVAL, PY_EVAL = "date '2000-07-01'", "date '1999-07-01'"
CY_FROM, CY_TO = "date '2000-03-31'", "date '2000-07-01'"
PY_FROM, PY_TO = "date '1999-03-31'", "date '1999-07-01'"


# --- fragments ---------------------------------------------------------------


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def typed(body: str, spec: str) -> str:
    """The body with its columns cast: i bigint, d double, r double to 4 places, others as is."""
    forms = {
        "i": "cast({0} as bigint) as {0}",
        "d": "cast({0} as double) as {0}",
        "r": "round(cast({0} as double), 4) + cast(0 as double) as {0}",
        "s": "{0}",
    }
    columns = [forms[kind].format(name) for name, kind in (c.split(":") for c in spec.split())]
    return as_sql(f"select {', '.join(columns)} from (\n{body}\n) typed_rows")


def on_market(d: str, p: str = "") -> str:
    """Inventory at a date, status by status."""
    lapsed = f"({p}close_date is null or {p}close_date > {d}) and {p}status_date > {d}"
    tests = {
        "Active": "",
        "Active Under Contract": "",
        "Pending": "",
        "Expired": lapsed,
        "Withdrawn": lapsed,
        "Canceled": lapsed,
        "Closed": f"coalesce({p}close_date, {p}status_date) > {d}",
    }
    parts = [
        f"({p}standard_status = '{s}' and {p}list_date < {d}{' and ' + extra if extra else ''})"
        for s, extra in tests.items()
    ]
    return f"({p}standard_status <> 'Coming Soon' and (" + " or ".join(parts) + "))"


def band(price: str, breaks, null_band="null") -> str:
    tests = [f"when {price} < {breaks[0]} then 1"]
    for i, (low, high) in enumerate(zip(breaks, breaks[1:]), start=2):
        tests.append(f"when {price} >= {low} and {price} < {high} then {i}")
    tests.append(f"when {price} >= {breaks[-1]} then {len(breaks) + 1}")
    return "case " + " ".join(tests) + f" else {null_band} end"


def band_text(column: str, breaks) -> str:
    top = len(breaks) + 1
    tests = [f"when {column} = 1 then '$0 - ${breaks[0] - 1:,}'"]
    for i, (low, high) in enumerate(zip(breaks, breaks[1:]), start=2):
        tests.append(f"when {column} = {i} then '${low:,} - ${high - 1:,}'")
    tests.append(f"when {column} = {top} then '${breaks[-1]:,}+'")
    return "case " + " ".join(tests) + " end"


def whole_avg(x: str) -> str:
    return f"cast((sum({x}) - sum({x}) % count({x})) / count({x}) as bigint)"


def money_avg(x: str) -> str:
    return f"cast(sum({x}) as double) / count({x})"


def real(a: str, b: str) -> str:
    return f"cast(cast(cast({a} as double) as float) / cast(cast({b} as double) as float) as float)"


def supply(a: str, b: str) -> str:
    return f"round(cast({real(a, b)} * 12 as double), 1)"


def days(a: str, b: str) -> str:
    return f"datediff('day', {a}, {b})"


def median(x: str, by: str) -> str:
    """Exact for whole numbers and cents: twice the median is a whole number of cents."""
    return f"round(median(cast({x} as double)) over (partition by {by}) * 200) / 200"


PPF = "avg(case when building_area > 0 then cast(close_price as double) / building_area end)"
CLASS = """case when property_type = 'Land' then 'Land'
  when property_type = 'Residential' and property_sub_type <> 'Condominium' then 'Single Family Residential'
  when property_type = 'Residential' and property_sub_type = 'Condominium' then 'Condominium'
  else 'Other' end"""
CODE = "trim(case when instr(area, '-') = 0 then area else substr(area, 1, instr(area, '-') - 1) end)"
COUNTY = "trim(regexp_replace(county_name, 'County', ''))"
GEO = "join listings_geo g on l.listing_key = g.listing_key and l.source_system_id = g.source_system_id"
NAMES = "join county_names cn on g.county_fp = cn.county_fp and g.state_fp = cn.state_num"
SALES_SPEC = "Qtr:i Yr:i price_per_foot:r sales_volume:d sales_count:i avg_sale:d avg_dom:i MedianPrice:d"


def label_case(labels) -> str:
    return "case " + " ".join(
        f"when {CODE} = '{code}' then {quoted([label])}" for code, label in labels.items()
    ) + " else '' end"


QUARTERLY_AREAS = [
    (label_case(K.AREA_LABELS), f"{CODE} in ({quoted(K.AREA_LABELS)})"),
    ("'South of Broad'", "subdivision = 'South of Broad'"),
    ("'CHS Tri-County'", f"county_or_parish in ({quoted(Q.TRI)})"),
]
SUPPLY_AREAS = [
    (label_case(K.AREA_LABELS_SUPPLY), f"{CODE} in ({quoted(K.AREA_LABELS_SUPPLY)})"),
    ("'Downtown Charleston (51-52)'", f"{CODE} in ('51', '52')"),
    ("'West Islands (23-26 & 30)'", f"{CODE} in ('23', '24', '25', '26', '30')"),
    ("'South of Broad'", "subdivision = 'South of Broad'"),
    ("'CHS Tri-County'", f"try_cast({CODE} as integer) between 11 and 78"),
]


def area_union(areas, columns: str, where: str = "") -> str:
    """One scan per area branch."""
    return "\nunion all\n".join(
        f"""select {label} as Area, {columns}
from listings l {GEO}
join area_listings m on l.listing_key = m.listing_key and l.source_system_id = m.source_system_id
where l.property_type = 'Residential' and {test} {where}"""
        for label, test in areas
    )


def sales(keys: str, source: str, extra_median_source: str | None = None) -> str:
    """Metrics by group joined to the windowed median of the group."""
    by = f"{keys}, quarter(close_date), year(close_date)"
    names = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"a.{k} = b.{k}" for k in [*names, "Qtr", "Yr"])
    return f"""select a.*, b.MedianPrice from (
  select {keys}, quarter(close_date) as Qtr, year(close_date) as Yr, {PPF} as price_per_foot,
    sum(close_price) as sales_volume, count(*) as sales_count, {money_avg('close_price')} as avg_sale,
    {whole_avg(days('list_date', 'close_date'))} as avg_dom
  from ({source}) src group by {by}
) a join (
  select distinct {keys}, quarter(close_date) as Qtr, year(close_date) as Yr,
    {median('close_price', by)} as MedianPrice
  from ({extra_median_source or source}) src
) b on {same}"""


# --- operators ---------------------------------------------------------------

CLOSED_TOWN = f"""select l.*, g.municipality, g.municipality_type, g.census_place
from listings l {GEO} where l.close_date is not null and l.property_type = 'Residential'"""


def kinds(where: str) -> str:
    return f"""select property_type, count(*) as n, sum(close_price) as volume
from listings where {where} group by property_type"""


def banded(breaks, list_null, close_null) -> str:
    return f"""select listing_key, {band('list_price', breaks, list_null)} as list_band,
{band('close_price', breaks, close_null)} as close_band from listings"""


SIDES = """select zone, list_office_key as office_key, list_price from broker_listings
union all
select zone, buyer_office_key as office_key, list_price from broker_listings
where buyer_office_key is not null"""
UNITS = f"select zone, office_key, count(*) as units from ({SIDES}) s group by zone, office_key"
RANKED = f"""select *, dense_rank() over (partition by zone order by units desc) as office_rank
from ({UNITS}) u"""


def yoy_supply(inventory_window: str, multiply: str) -> str:
    return f"""select a.municipality, {multiply} as months_inventory from (
  select distinct municipality from listings_geo) a
left join (select municipality, count(*) as n from listings l {GEO}
  where {on_market(EVAL)} group by municipality) i on a.municipality = i.municipality
left join (select municipality, count(*) as n from listings l {GEO}
  where close_price > 0 and {inventory_window} group by municipality) s
  on a.municipality = s.municipality"""


TAB_TEXT = """select distinct t1.tab_name as TabName, t1.tab_header as TabHeader,
  (select string_agg(t2.service_area, ', ' order by t2.service_area) from custom_tabs t2
   where t2.tab_name = t1.tab_name) as message_text
from custom_tabs t1"""

PREFIX = """case when not regexp_matches(office_mls_id, '[A-Za-z]$')
  and regexp_matches(office_mls_id, '[A-Za-z]')
  then regexp_replace(office_mls_id, '[^A-Za-z]+$', '') else '' end"""
MIXED_ID = "(case when office_key % 2 = 0 then lower(office_mls_id) else office_mls_id end)"
FIRMS = f"""select FirmPrefix, Firm from (
  select *, row_number() over (partition by FirmPrefix order by Firm nulls first) as ranked from (
    select distinct {PREFIX} as FirmPrefix,
      case when company is null then office_name else company end as Firm
    from broker_offices where {PREFIX} <> '') d
) r where ranked = 1"""

OPERATORS = {
    "scan_listings": typed(
        "select listing_key, source_system_id, standard_status, list_date, list_price from listings",
        "listing_key:i source_system_id:i standard_status:s list_date:s list_price:d",
    ),
    "inline_relation_join": typed(
        f"""select municipality, municipality_type, count(*) as n from listings_geo g
join (values {', '.join(f"('{a}', '{b}')" for a, b in Q.TOWNS)}) as v(muni, muni_type)
on g.municipality = v.muni and g.municipality_type = v.muni_type
group by municipality, municipality_type""",
        "municipality:s municipality_type:s n:i",
    ),
    "split_param_join": typed(
        f"""select property_sub_type, count(*) as n from listings l
join (select unnest(string_split('{Q.SUBTYPES}', ',')) as item) i on l.property_sub_type = i.item
group by property_sub_type""",
        "property_sub_type:s n:i",
    ),
    "split_lateral": typed(
        """select tab_name, service_area, item_number, items[item_number] as item from (
  select *, unnest(generate_series(1, len(items))) as item_number from (
    select *, string_split(concat(tab_header, '/', service_area, '//'), '/') as items
    from custom_tabs where tab_type <> 'Zone') s) u""",
        "tab_name:s service_area:s item_number:i item:s",
    ),
    "catalog_names": typed(
        """select n.county_fp, n.county, r.region from county_names n
join county_by_region r on n.county = r.county""",
        "county_fp:i county:s region:s",
    ),
    "distinct_lookup": typed(
        f"""select distinct property_sub_type from property_subtypes
where property_sub_type in ({quoted(K.PROPERTY_SUBTYPES)})""",
        "property_sub_type:s",
    ),
    "append_union": typed(
        f"""select municipality, region, property_type, count(*) as n from (
  select g.municipality, r.region, l.property_type from listings l {GEO}
  join (select distinct region, county from county_by_region) r on g.municipality = r.county
  where g.municipality in ({quoted(Q.TRI)})
  union all
  select g.municipality, null as region, l.property_type from listings l {GEO}
  where g.municipality = '{Q.FOURTH}'
) u group by municipality, region, property_type""",
        "municipality:s region:s property_type:s n:i",
    ),
    "dedupe_keep_first": typed(FIRMS, "FirmPrefix:s Firm:s"),
    "firm_ids_ignore_case": typed(
        f"""select upper(FirmPrefix) as FirmPrefix, Firm from (
  select *, row_number() over (partition by lower(FirmPrefix) order by Firm nulls first) as ranked from (
    select distinct {PREFIX.replace('office_mls_id', MIXED_ID)} as FirmPrefix,
      case when company is null then office_name else company end as Firm
    from broker_offices where {PREFIX.replace('office_mls_id', MIXED_ID)} <> '') d
) r where ranked = 1""",
        "FirmPrefix:s Firm:s",
    ),
    "project_star": typed(
        f"select l.*, {days('list_date', 'close_date')} as dom from listings l",
        "listing_key:i source_system_id:i standard_status:s property_type:s property_sub_type:s "
        "list_date:s contract_date:s close_date:s status_date:s list_price:d close_price:d "
        "building_area:i list_office_key:i buyer_office_key:i dom:i",
    ),
    "property_class": typed(
        f"select listing_key, {CLASS} as property_class from listings",
        "listing_key:i property_class:s",
    ),
    "area_code": typed(
        f"select listing_key, {CODE} as area_code from area_listings", "listing_key:i area_code:s"
    ),
    "area_label": typed(
        f"select listing_key, {label_case(K.AREA_LABELS)} as Area from area_listings",
        "listing_key:i Area:s",
    ),
    "area_label_ytd": typed(
        f"select listing_key, {label_case(K.AREA_LABELS_SUPPLY)} as Area from area_listings",
        "listing_key:i Area:s",
    ),
    "overlapping_areas": typed(
        "\nunion all\n".join(
            f"select listing_key, {label} as Area from area_listings where {test}"
            for label, test in QUARTERLY_AREAS
        ),
        "listing_key:i Area:s",
    ),
    "price_band_5": typed(banded(K.BREAKS_5, 5, "null"), "listing_key:i list_band:i close_band:i"),
    "price_band_4": typed(banded(K.BREAKS_4, 4, "null"), "listing_key:i list_band:i close_band:i"),
    "price_band_16": typed(banded(K.BREAKS_16, 16, 16), "listing_key:i list_band:i close_band:i"),
    "band_label": typed(
        f"""select listing_key, {band_text('b', K.BREAKS_5)} as band
from (select listing_key, {band('list_price', K.BREAKS_5, 5)} as b from listings) x""",
        "listing_key:i band:s",
    ),
    "brand_normalise": typed(
        """select office_key, office_name, case
  when office_name like 'Supplier#00000000%' then 'First Ten'
  when office_name like '%5' then 'Fives'
  when office_name like '%#0000000_2%' then 'Twenties' else 'Other' end as company
from offices""",
        "office_key:i office_name:s company:s",
    ),
    "firm_prefix": typed(
        f"select office_key, office_mls_id, {PREFIX} as firm_prefix from broker_offices",
        "office_key:i office_mls_id:s firm_prefix:s",
    ),
    "coalesce_name": typed(
        """select office_key, case when company is null then office_name else company end as firm
from broker_offices""",
        "office_key:i firm:s",
    ),
    "county_clean": typed(
        f"select county_fp, county_name, {COUNTY} as county from county_names",
        "county_fp:i county_name:s county:s",
    ),
    "days_on_market": typed(
        f"""select listing_key, {days('list_date', 'close_date')} as to_close,
{days('list_date', 'contract_date')} as to_contract from listings""",
        "listing_key:i to_close:i to_contract:i",
    ),
    "zone_key": typed(
        "select distinct tab_name, substr(tab_name, instr(tab_name, ' ') + 1) as zone from custom_tabs",
        "tab_name:s zone:s",
    ),
    "filter_basic": typed(
        """select listing_key, property_type, standard_status from listings
where property_type in ('Residential', 'Land') and source_system_id not in (4, 8)
  and standard_status <> 'Coming Soon' and building_area is not null
  and (close_price is null or property_sub_type = 'Duplex')""",
        "listing_key:i property_type:s standard_status:s",
    ),
    "filter_like": typed(
        """select custom_geo, count(*) as n from listings_custom_geo
where lower(custom_geo) like '%lakefront%' group by custom_geo""",
        "custom_geo:s n:i",
    ),
    "filter_between_cast": typed(
        f"""select listing_key, area from area_listings
where try_cast({CODE} as integer) between 15 and 28""",
        "listing_key:i area:s",
    ),
    "inventory_asof": typed(
        f"""select a.standard_status, a.property_type, coalesce(b.n, 0) as on_market from (
  select distinct standard_status, property_type from listings) a left join (
  select standard_status, property_type, count(*) as n from listings
  where {on_market(EVAL)} group by standard_status, property_type) b
on a.standard_status = b.standard_status and a.property_type = b.property_type""",
        "standard_status:s property_type:s on_market:i",
    ),
    "window_trailing_year": typed(
        kinds("close_date <= date '2000-06-30' and close_date > date '1999-06-30'"),
        "property_type:s n:i volume:d",
    ),
    "window_trailing_quarter": typed(
        kinds("close_date <= date '2000-06-30' and close_date > date '2000-03-30'"),
        "property_type:s n:i volume:d",
    ),
    "window_half_open_year": typed(
        kinds("close_date < date '2000-07-01' and close_date >= date '1999-07-01'"),
        "property_type:s n:i volume:d",
    ),
    "window_six_months": typed(
        kinds("close_date < date '2000-07-01' and close_date >= date '2000-01-01'"),
        "property_type:s n:i volume:d",
    ),
    "window_open_interval": typed(
        kinds(f"contract_date > {CY_FROM} and contract_date < {CY_TO}"), "property_type:s n:i volume:d"
    ),
    "filter_quarter": typed(
        kinds("quarter(close_date) = 3 and year(close_date) = 1999"), "property_type:s n:i volume:d"
    ),
    "source_scope": typed(
        f"""select municipality as County, l.source_system_id, count(*) as n from listings l {GEO}
where (l.source_system_id = 1 or l.source_system_id = 4 or l.source_system_id = 8)
  and municipality in ({quoted(Q.TRI)})
group by 1, 2
union all
select municipality as County, l.source_system_id, count(*) as n from listings l {GEO}
where l.source_system_id = 10 and municipality = '{Q.FOURTH}' group by 1, 2""",
        "County:s source_system_id:i n:i",
    ),
    "yoy_view": typed(
        f"""select listing_key, municipality, quarter(close_date) as Qtr, year(close_date) as Yr
from ({CLOSED_TOWN}) c where quarter(close_date) = 2 and year(close_date) >= 2000 - 1""",
        "listing_key:i municipality:s Qtr:i Yr:i",
    ),
    "join_two_keys": typed(
        f"""select municipality, area, count(*) as n from listings l {GEO}
join area_listings m on l.listing_key = m.listing_key and l.source_system_id = m.source_system_id
group by municipality, area""",
        "municipality:s area:s n:i",
    ),
    "join_dimension": typed(
        f"select county_name, count(*) as n from listings_geo g {NAMES} group by county_name",
        "county_name:s n:i",
    ),
    "join_computed_key": typed(
        f"""select municipality, state_num, count(*) as n from listings_geo g
join county_names cn on g.municipality = {COUNTY} group by municipality, state_num""",
        "municipality:s state_num:i n:i",
    ),
    "join_distinct_dim": typed(
        """select municipality, count(*) as n from listings_geo g
join (select distinct region, county from county_by_region) r on r.county = g.municipality
group by municipality""",
        "municipality:s n:i",
    ),
    "semi_filter": typed(
        f"""select listing_key, property_sub_type from listings l
join (values {', '.join(f"('{s}')" for s in Q.SUBTYPES.split(','))}) v(item)
on l.property_sub_type = v.item""",
        "listing_key:i property_sub_type:s",
    ),
    "semi_exists": typed(
        f"""select property_type, count(*) as n, sum(close_price) as volume
from listings l {GEO} where g.county_fp = 3 group by property_type""",
        "property_type:s n:i volume:d",
    ),
    "left_join_metrics": typed(
        f"""with rows_in as (select l.*, municipality as County from listings l {GEO}
  where municipality in ({quoted([*Q.TRI, Q.FOURTH])}))
select a.County, a.property_type, a.closed, i.n as inventory, s.n as sold from (
  select County, property_type, count(*) as closed from rows_in
  where close_date is not null group by County, property_type) a
left join (select County, property_type, count(*) as n from rows_in where {on_market(EVAL)}
  group by County, property_type) i on a.County = i.County and a.property_type = i.property_type
left join (select County, property_type, count(*) as n from rows_in
  where close_date < {EVAL} and close_date >= {PY_EVAL} and close_price > 0
  group by County, property_type) s on a.County = s.County and a.property_type = s.property_type""",
        "County:s property_type:s closed:i inventory:i sold:i",
    ),
    "left_join_const": typed(
        f"""with banded as (select *, {band('list_price', K.BREAKS_16, 16)} as band from listings)
select i.band, i.total_listings, d.avg_dom from (
  select band, count(*) as total_listings from banded where {on_market(EVAL)} group by band) i
left join (select band, year(close_date) as yr,
  {whole_avg(days('list_date', 'close_date'))} as avg_dom
  from banded where close_date is not null group by band, year(close_date)) d
on i.band = d.band and d.yr = 2001""",
        "band:i total_listings:i avg_dom:i",
    ),
    "anti_join": typed(
        f"""with closed as ({CLOSED_TOWN}),
sold as (select distinct municipality, quarter(close_date) as Qtr, year(close_date) as Yr from closed),
grid as (select g.municipality, p.Qtr, p.Yr
  from (select distinct municipality from listings_geo) g
  cross join (select distinct Qtr, Yr from sold) p),
condos as (select distinct municipality, quarter(close_date) as Qtr, year(close_date) as Yr
  from closed where property_sub_type = 'Condominium')
select grid.* from grid left join condos c
on grid.municipality = c.municipality and grid.Qtr = c.Qtr and grid.Yr = c.Yr
where c.municipality is null""",
        "municipality:s Qtr:i Yr:i",
    ),
    "densify_cross": typed(
        """select g.custom_geo, p.Qtr, p.Yr from (select distinct custom_geo from listings_custom_geo) g
cross join (select distinct quarter(close_date) as Qtr, year(close_date) as Yr from listings
  where close_date is not null) p""",
        "custom_geo:s Qtr:i Yr:i",
    ),
    "sales_stats": typed(sales("municipality", CLOSED_TOWN), "municipality:s " + SALES_SPEC),
    "share_of_total": typed(
        f"""select p.property_type, p.office_key, {real('p.sides', 't.sides')} * 100 as sides_share,
  {real('p.volume', 't.volume')} * 100 as volume_share from (
  select property_type, office_key, sum(sides) as sides, sum(volume_credit) as volume
  from listing_sides group by property_type, office_key) p
join (select property_type, sum(sides) as sides, sum(volume_credit) as volume
  from listing_sides group by property_type) t on p.property_type = t.property_type""",
        "property_type:s office_key:i sides_share:r volume_share:r",
    ),
    "rank_up_to_own": typed(
        f"""with ranked as ({RANKED})
select t.zone, t.office_key, t.units, t.office_rank from ranked t
join (select zone, office_rank from ranked where office_key = 5) a on t.zone = a.zone
where t.office_rank <= case when a.office_rank > 5 then a.office_rank else 5 end""",
        "zone:s office_key:i units:i office_rank:i",
    ),
    "explode_sides": typed(
        f"""select office_key, count(*) as units, sum(list_price) as list_volume
from ({SIDES}) s group by office_key""",
        "office_key:i units:i list_volume:d",
    ),
    "group_by_expr": typed(
        f"""select {CLASS} as property_class, quarter(close_date) as Qtr, year(close_date) as Yr,
count(*) as n from listings where close_date is not null group by 1, 2, 3""",
        "property_class:s Qtr:i Yr:i n:i",
    ),
    "avg_dom_trunc": typed(
        f"""select municipality, {whole_avg(days('list_date', 'close_date'))} as avg_dom
from ({CLOSED_TOWN}) c group by municipality""",
        "municipality:s avg_dom:i",
    ),
    "median_price": typed(
        f"""select distinct municipality, year(close_date) as Yr,
{median('close_price', 'municipality, year(close_date)')} as median_price from ({CLOSED_TOWN}) c""",
        "municipality:s Yr:i median_price:d",
    ),
    "median_dom": typed(
        f"""select distinct municipality,
{median(days('list_date', 'close_date'), 'municipality')} as median_dom from ({CLOSED_TOWN}) c""",
        "municipality:s median_dom:d",
    ),
    "distinct_rows": typed(
        "select distinct municipality, municipality_type from listings_geo",
        "municipality:s municipality_type:s",
    ),
    "service_area_list": typed(TAB_TEXT, "TabName:s TabHeader:s message_text:s"),
    "yoy_pivot": typed(
        f"""select a.municipality, p.v as volume_py, c.v as volume_cy from (
  select distinct municipality from ({CLOSED_TOWN}) x) a
left join (select municipality, sum(close_price) as v from ({CLOSED_TOWN}) x
  where year(close_date) = 1999 group by municipality) p on a.municipality = p.municipality
left join (select municipality, sum(close_price) as v from ({CLOSED_TOWN}) x
  where year(close_date) = 2000 group by municipality) c on a.municipality = c.municipality""",
        "municipality:s volume_py:d volume_cy:d",
    ),
    "months_inventory_year": typed(
        yoy_supply(f"close_date < {EVAL} and close_date >= {PY_EVAL}", supply("i.n", "s.n")),
        "municipality:s months_inventory:d",
    ),
    "months_inventory_qtr": typed(
        yoy_supply(
            "close_date <= date '2000-06-30' and close_date > date '2000-03-30'",
            f"{real('i.n', 's.n')} * 3",
        ),
        "municipality:s months_inventory:r",
    ),
    "unit_share": typed(
        f"""select u.zone, u.office_key, cast(u.units as double) / cast(t.units as double) as share
from ({UNITS}) u join (select zone, count(*) as units from ({SIDES}) s
  where office_key is not null group by zone) t on u.zone = t.zone""",
        "zone:s office_key:i share:d",
    ),
    "dense_rank_blocks": typed(RANKED, "zone:s office_key:i units:i office_rank:i"),
    "dense_rank_units": typed(RANKED, "zone:s office_key:i units:i office_rank:i"),
    "yoy_change": typed(
        f"""with counts as (select municipality, quarter(close_date) as Qtr, year(close_date) as Yr,
  count(*) as n from ({CLOSED_TOWN}) c group by 1, 2, 3)
select c.municipality, c.Qtr, c.Yr, c.n, cast(c.n - p.n as double) / p.n as change
from counts c left join counts p
  on c.municipality = p.municipality and c.Qtr = p.Qtr and p.Yr = c.Yr - 1""",
        "municipality:s Qtr:i Yr:i n:i change:d",
    ),
    "order_multi": typed(UNITS + " order by zone, units desc, office_key", "zone:s office_key:i units:i"),
    "order_custom": typed(
        f"""select {band_text('b', K.BREAKS_5)} as band, n from (
  select {band('list_price', K.BREAKS_5, 5)} as b, count(*) as n from listings group by 1) x order by b""",
        "band:s n:i",
    ),
    "order_zone_number": typed(
        """select tab_name, count(*) as areas from custom_tabs where tab_type = 'Zone'
group by tab_name order by cast(split_part(tab_name, ' ', 2) as integer)""",
        "tab_name:s areas:i",
    ),
    "union_all_levels": typed(
        """select municipality as place, municipality_type as kind, count(*) as n from listings_geo
group by 1, 2
union all
select census_place as place, null as kind, count(*) as n from listings_geo group by 1, 2""",
        "place:s kind:s n:i",
    ),
    "two_year_inventory": typed(
        f"""select 2000 as Yr, municipality, count(*) as listings from listings l {GEO}
where {on_market(EVAL)} group by municipality
union all
select 1999 as Yr, municipality, count(*) as listings from listings l {GEO}
where {on_market(PY_EVAL)} group by municipality""",
        "municipality:s Yr:i listings:i",
    ),
}


def day_frames(columns: dict[str, str]) -> str:
    named = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
    return f"""select list_date, n, {named} from (
select list_date, count(*) as n, cast(date_trunc('quarter', list_date) as date) as q
from listings group by list_date) x"""


def day(expr: str) -> str:
    return f"cast({expr} as date)"


_OPEN = {
    "cy_start": day("q - interval 3 month - interval 1 day"),
    "cy_end": day("q"),
    "py_start": day("cast(q - interval 3 month - interval 1 day as date) - interval 1 year"),
    "py_end": day("q - interval 1 year"),
}
OPERATORS |= {
    "date_frame_quarter": typed(
        day_frames(
            {
                "start": day("q - interval 3 month"),
                "\"end\"": day("q - interval 1 day"),
                "py_start": day("q - interval 3 month - interval 1 year"),
                "py_end": day("cast(q - interval 1 day as date) - interval 1 year"),
                "quarter": "quarter(list_date)",
                "previous_quarter": "quarter(q - interval 1 day)",
                "year": "year(list_date)",
                "previous_year": "year(list_date) - 1",
            }
        ),
        "list_date:s n:i start:s \"end\":s py_start:s py_end:s quarter:i previous_quarter:i year:i "
        "previous_year:i",
    ),
    "date_frame_eval": typed(
        day_frames(
            {
                "eval_date": "list_date",
                "py_eval_date": day("list_date - interval 1 year"),
                "quarter": "quarter(list_date)",
                "year": "year(list_date)",
                "previous_year": "year(list_date) - 1",
            }
        ),
        "n:i eval_date:s py_eval_date:s quarter:i year:i previous_year:i",
    ),
    "date_frame_open": typed(
        day_frames(_OPEN), "list_date:s n:i cy_start:s cy_end:s py_start:s py_end:s"
    ),
    "date_frame_labels": typed(
        day_frames(
            {
                name: f"strftime({_OPEN[name]} {shift} interval 1 day, '%b %Y')"
                for name, shift in (
                    ("cy_start", "+"), ("cy_end", "-"), ("py_start", "+"), ("py_end", "-"),
                )
            }
        ),
        "list_date:s n:i cy_start:s cy_end:s py_start:s py_end:s",
    ),
}


# --- reports -----------------------------------------------------------------


def market_area() -> str:
    by = "Area, quarter(close_date), year(close_date)"

    def inv(year_of: str, d: str) -> str:
        return f"""select year({year_of}) as InvYear, Area, count(*) as total_listings
from work_lci where {on_market(d)} group by Area"""

    return f"""with work_lci as (
{area_union(QUARTERLY_AREAS, 'l.standard_status, l.list_date, l.close_date, l.status_date')}
), cte as (
{area_union(
    QUARTERLY_AREAS,
    "l.close_date, l.close_price, l.building_area, " + days('m.list_date', 'm.close_date') + " as dom",
    "and l.close_date is not null",
)}
)
select a.*, b.MedianPrice, inv.total_listings as ActiveListings, d.avg_DOM from (
  select Area, quarter(close_date) as Qtr, year(close_date) as Yr, {PPF} as price_per_foot,
    sum(close_price) as sales_volume, count(*) as sales_count, {money_avg('close_price')} as avg_sale
  from cte group by {by}) a
join (select distinct Area, quarter(close_date) as Qtr, year(close_date) as Yr,
    {median('close_price', by)} as MedianPrice from cte) b
  on a.Yr = b.Yr and a.Qtr = b.Qtr and a.Area = b.Area
left join ({inv(CY_END, EVAL)} union all {inv(PY_END, PY_EVAL)}) inv
  on a.Yr = inv.InvYear and a.Area = inv.Area
left join (select distinct Area, quarter(close_date) as Qtr, year(close_date) as Yr,
    {median('dom', by)} as avg_DOM from cte) d on a.Yr = d.Yr and a.Qtr = d.Qtr and a.Area = d.Area"""


def price_range_area() -> str:
    def inv(d: str) -> str:
        return f"""select Area, b, count(*) as total_listings from work_lci
where {on_market(d)} group by Area, b"""

    def solds(end: str, start: str) -> str:
        return f"""select Area, b, count(*) as total_sold, sum(close_price) as total_volume_sold
from cte where close_date <= {end} and close_date > {start} and close_price > 0 group by Area, b"""

    def year_part(end: str, inv_name: str, sold_name: str) -> str:
        return f"""select distinct year({end}) as Yr, i.Area as area,
  {band_text('i.b', K.BREAKS_4)} as listpricebucket, i.total_listings, d.dom as avg_DOM,
  s.total_sold, s.total_volume_sold, {real('i.total_listings', 's.total_sold')} * 3 as months_inventory
from {inv_name} i
left join dom d on i.Area = d.Area and i.b = d.b and d.yr = year({end})
left join {sold_name} s on i.Area = s.Area and i.b = s.b"""

    list_band = band("l.list_price", K.BREAKS_4, 4)
    return f"""with work_lci as (
{area_union(QUARTERLY_AREAS, f'{list_band} as b, l.standard_status, l.list_date, l.close_date, l.status_date')}
), cte as (
{area_union(QUARTERLY_AREAS, f'{list_band} as b, l.list_date, l.close_date, l.close_price',
            'and l.close_date is not null')}
), inv as ({inv(EVAL)}), pyinv as ({inv(PY_EVAL)}),
sq as ({solds(CY_END, "date '2000-03-30'")}), pysq as ({solds(PY_END, "date '1999-03-30'")}),
dom as (select year(close_date) as yr, Area, b, {whole_avg(days('list_date', 'close_date'))} as dom
  from cte where quarter(close_date) = quarter({CY_END}) and year(close_date) > year({PY_END}) - 1
  group by year(close_date), Area, b)
{year_part(CY_END, 'inv', 'sq')}
union all
{year_part(PY_END, 'pyinv', 'pysq')}"""


def supply_demand(end: str, start: str, d: str, report_year: int, breaks) -> str:
    top = len(breaks) + 1
    window = f"close_date < {end} and close_date >= {start} and close_price > 0"

    def part(main: str, sort: str, where: str, other: str) -> str:
        return f"""select distinct {main}.Area, {main}.{sort} as Sort,
  {band_text(f'{main}.{sort}', breaks)} as ListPriceBucket, inv.total_listings as ActiveListings,
  solds.total_sold as Sold_Prior6Months, dom.dom as AvgDOM
from {main} left join {other}
  on inv.Area = solds.Area and inv.list_band = solds.close_band
left join dom on {main}.Area = dom.Area and {main}.{sort} = dom.close_band and dom.yr = {report_year}
{where}"""

    return f"""with work_lci as (
{area_union(SUPPLY_AREAS, f"{band('l.list_price', breaks, top)} as list_band, "
            "l.standard_status, l.list_date, l.close_date, l.status_date")}
), cte as (
{area_union(SUPPLY_AREAS, f"{band('l.close_price', breaks, top)} as close_band, "
            "l.list_date, l.close_date, l.close_price", 'and l.close_date is not null')}
), inv as (select Area, list_band, count(*) as total_listings from work_lci
  where {on_market(d)} group by Area, list_band),
solds as (select Area, close_band, count(*) as total_sold from cte where {window}
  group by Area, close_band),
dom as (select year(close_date) as yr, Area, close_band,
  {whole_avg(days('list_date', 'close_date'))} as dom from cte where {window}
  group by year(close_date), Area, close_band)
{part('solds', 'close_band', '', 'inv')}
union all
{part('inv', 'list_band', 'where solds.close_band is null', 'solds')}"""


def county_work(columns: str, types: str, tri, fourth: str) -> str:
    """Listings of the covering sources, once per region for the three counties."""
    return f"""select {columns}, cbr.county as County from listings l {GEO} {NAMES}
join (select distinct region, county from county_by_region where region <> 'Milwaukee') cbr
  on cbr.county = {COUNTY}
where (l.source_system_id = 1 or l.source_system_id = 4 or l.source_system_id = 8)
  and cn.county in ({quoted(tri)}) and l.property_type in ({types})
union all
select {columns}, cn.county as County from listings l {GEO} {NAMES}
where l.source_system_id = 10 and cn.county = '{fourth}' and l.property_type in ({types})"""


def price_range_county(scope=Q.SCOPE_BANDS) -> str:
    def inv(d: str) -> str:
        return f"""select County, b, count(*) as total_listings from cte
where {on_market(d)} group by County, b"""

    def solds(end: str, start: str) -> str:
        return f"""select County, b, count(*) as total_sold, sum(close_price) as total_volume_sold
from cte where close_date <= {end} and close_date > {start} and close_price > 0 group by County, b"""

    def part(end: str, inv_name: str, sold_name: str) -> str:
        return f"""select year({end}) as Yr, i.County as county,
  {band_text('i.b', K.BREAKS_5)} as listpricebucket, i.total_listings, d.dom as avg_DOM,
  s.total_sold, s.total_volume_sold, {real('i.total_listings', 's.total_sold')} * 12 as months_inventory
from {inv_name} i join {sold_name} s on i.County = s.County and i.b = s.b
join dom d on i.County = d.County and i.b = d.b and d.yr = year({end})"""

    columns = f"l.*, {band('l.list_price', K.BREAKS_5, 5)} as b"
    return f"""with cte as ({county_work(columns, "'Residential'", scope.counties, scope.fourth)}),
inv as ({inv(CY_END)}), pyinv as ({inv(PY_END)}),
solds as ({solds(CY_END, PY_END)}), pysolds as ({solds(PY_END, "date '1998-06-30'")}),
dom as (select year(close_date) as yr, County, b, {whole_avg(days('list_date', 'close_date'))} as dom
  from cte where quarter(close_date) = quarter({CY_END}) and year(close_date) > year({PY_END}) - 1
  group by year(close_date), County, b)
{part(CY_END, 'inv', 'solds')}
union all
{part(PY_END, 'pyinv', 'pysolds')}"""


COUNTY_SALES = f"""select l.*, {COUNTY} as County, {CLASS} as PropertyType
from (select listing_key, source_system_id, property_type, property_sub_type, list_date, close_date,
  close_price, building_area from listings) l {GEO} {NAMES}
where {COUNTY} in ({quoted([*Q.TRI, Q.FOURTH])})
  and close_date is not null and property_type in ('Residential', 'Land')"""
YEAR_PARTS = {
    "cy": ("quarter(close_date) = 3 and year(close_date) = 2000", EVAL, PY_EVAL),
    "py": ("quarter(close_date) = 3 and year(close_date) = 1999", PY_EVAL, "date '1998-07-01'"),
}
NO_FOURTH = f"County not in ('{Q.FOURTH}')"
LISTED = "PropertyType in ('Single Family Residential', 'Condominium')"


COVERED = f"""(County <> '{Q.FOURTH}' and source_system_id in (1, 4, 8)
  and County in (select county from county_by_region where region <> 'Milwaukee')
  or County = '{Q.FOURTH}' and source_system_id = 10)"""


def county_ctes(sold_class: str, with_class: bool, strict: bool = True) -> list[str]:
    """One aggregate per grain, year and metric."""
    grains = {"county": ("County", "true"), "tri": ("'WI'", NO_FOURTH)}
    if with_class:
        grains |= {
            "cell": ("County, PropertyType", "true"), "class": ("PropertyType", NO_FOURTH),
        }
    work = county_work(
        f"l.standard_status, l.list_date, l.close_date, l.status_date, l.close_price, {CLASS} as PropertyType",
        "'Residential', 'Land'", Q.TRI, Q.FOURTH,
    )
    county_sales = COUNTY_SALES if strict else f"select * from ({COUNTY_SALES}) every_source where {COVERED}"
    ctes = [f"work_lci as ({work})", f"county_sales as ({county_sales})"]
    for y, (in_quarter, d, before) in YEAR_PARTS.items():
        for name, (keys, test) in grains.items():
            group = f"group by {keys}" if name != "tri" else ""
            some = "" if name != "tri" else "having count(*) > 0"
            out = keys if name != "tri" else "'WI' as CensusState"
            ctes += [
                f"{y}_inv_{name} as (select {out}, count(*) as n from work_lci "
                f"where {test} and {LISTED} and {on_market(d)} {group} {some})",
                f"{y}_sold_{name} as (select {out}, count(*) as n from work_lci where {test} "
                f"and {sold_class} and close_date < {d} and close_date >= {before} "
                f"and close_price > 0 {group} {some})",
                f"{y}_med_{name} as (select distinct {out}, {median('close_price', keys)} as v "
                f"from county_sales where {test} and {in_quarter})",
                f"{y}_ppf_{name} as (select {out}, {PPF} as v from county_sales "
                f"where {test} and {in_quarter} {group} {some})",
            ]
        main = "cell" if with_class else "county"
        keys = grains[main][0]
        ctes.append(
            f"{y}_main as (select {keys}, count(*) as sales_count, {PPF} as price_per_foot, "
            f"sum(close_price) as sales_volume, {money_avg('close_price')} as avg_sale, "
            f"{whole_avg(days('list_date', 'close_date'))} as avg_dom from county_sales "
            f"where {in_quarter} group by {keys})"
        )
    return ctes


def county_class(strict: bool = True) -> str:
    names = [f"{y}_{m}_{g}" for y in YEAR_PARTS for m in ("inv", "sold", "med", "ppf")
             for g in ("cell", "county", "class", "tri")]
    on = {
        "cell": "rpt.PropertyType = {0}.PropertyType and rpt.County = {0}.County",
        "county": "rpt.County = {0}.County",
        "class": "rpt.PropertyType = {0}.PropertyType",
        "tri": "rpt.CensusState = {0}.CensusState",
    }
    joins = [f"left join {n} on {on[n.rsplit('_', 1)[1]].format(n)}" for n in names]
    joins += [f"left join {y}_main on {on['cell'].format(y + '_main')}" for y in YEAR_PARTS]
    columns = []
    for y, word in (("cy", "Current"), ("py", "Previous")):
        columns += [
            f"{y}_main.sales_count as {word}YearSalesCount",
            f"{y}_main.price_per_foot as {word}PricePerFoot",
            f"{y}_ppf_class.v as {word}TriCountyPricePerFoot",
            f"{y}_ppf_county.v as {word}AllUnitTypesPricePerFoot",
            f"{y}_ppf_tri.v as {word}TriCountyPricePerFootAllUnitTypes",
            f"{y}_main.sales_volume as {word}SalesVolume",
            f"{y}_main.avg_sale as {word}AvgSale",
            f"{y}_main.avg_dom as {word}AvgDOM",
            f"{y}_med_cell.v as {word}MedianPrice",
            f"{y}_med_class.v as {word}TriCountyMedian",
            f"{y}_med_county.v as {word}AllUnitTypesMedian",
            f"{y}_med_tri.v as {word}MedianTriCountyAllUnitTypes",
        ]
    for y in YEAR_PARTS:
        for grain, name in (("cell", ""), ("class", "TriCounty_"), ("county", "AllUnitTypes_"),
                            ("tri", "TriCountyAllUnitTypes_")):
            sold_year = "py" if grain == "class" and strict else y
            columns.append(
                f"{supply(f'{y}_inv_{grain}.n', f'{sold_year}_sold_{grain}.n')} "
                f"as {y}_{name}months_inventory"
            )
    return f"""with {', '.join(county_ctes('true', True, strict))}
select rpt.PropertyType, rpt.County, {', '.join(columns)}
from (select 'WI' as CensusState, PropertyType, County from cy_main
  union select 'WI' as CensusState, PropertyType, County from py_main) rpt
{' '.join(joins)}
where rpt.PropertyType <> 'Other'"""


def county_all(strict: bool = True) -> str:
    on = {"county": "rpt.County = {0}.County", "tri": "rpt.CensusState = {0}.CensusState"}
    names = [f"{y}_{m}_{g}" for y in YEAR_PARTS for m in ("inv", "sold", "med", "ppf") for g in on]
    joins = [f"left join {n} on {on[n.rsplit('_', 1)[1]].format(n)}" for n in names]
    columns = []
    for y, word in (("cy", "Current"), ("py", "Previous")):
        joins += [
            f"left join {y}_main on rpt.County = {y}_main.County",
            f"left join (select * from {y}_ppf_county where {NO_FOURTH}) {y}_own "
            f"on rpt.County = {y}_own.County",
        ]
        columns += [
            f"{y}_main.sales_count as {word}YearSalesCount",
            f"{y}_main.price_per_foot as {word}PricePerFoot",
            f"{f'{y}_own' if strict else f'{y}_ppf_tri'}.v as {word}TriCountyPricePerFoot",
            f"{y}_main.sales_volume as {word}SalesVolume",
            f"{y}_main.avg_sale as {word}AvgSale",
            f"{y}_main.avg_dom as {word}AvgDOM",
            f"{y}_med_county.v as {word}MedianPrice",
            f"{y}_med_tri.v as {word}TriCountyMedian",
        ]
    for y in YEAR_PARTS:
        columns += [
            f"{supply(f'{y}_inv_county.n', f'{y}_sold_county.n')} as {y}_months_inventory",
            f"{supply(f'{y}_inv_tri.n', f'{'py' if strict else y}_sold_tri.n')} as {y}_TriCounty_months_inventory",
        ]
    return f"""with {', '.join(county_ctes("PropertyType <> 'Other'", False, strict))}
select rpt.County, {', '.join(columns)}
from (select 'WI' as CensusState, County from cy_main
  union select 'WI' as CensusState, County from py_main) rpt
{' '.join(joins)}"""


def grouping_sets() -> str:
    parts = []
    for grain, (county, kind) in {
        "cell": ("County", "PropertyType"), "county": ("County", "null"),
        "class": ("null", "PropertyType"), "all": ("null", "null"),
    }.items():
        g = "tri" if grain == "all" else grain
        keys = [k for k in (county, kind) if k != "null"]

        def join(name: str) -> str:
            same = " and ".join(f"k.{c} = {name}.{c}" for c in keys) or "true"
            return f"left join {name} on {same}"

        known = " union ".join(
            f"select distinct {', '.join(keys) or 1} from {table} where "
            f"{'true' if county != 'null' else NO_FOURTH} {extra}"
            for table, extra in (
                ("county_sales", f"and (({YEAR_PARTS['cy'][0]}) or ({YEAR_PARTS['py'][0]}))"),
                ("work_lci", f"and ({LISTED} and ({on_market(EVAL)} or {on_market(PY_EVAL)}) "
                 f"or close_price > 0 and close_date < {EVAL} and close_date >= date '1998-07-01')"),
            )
        )
        counts = " ".join(
            f"left join (select {', '.join(keys + ['count(*) as n'])} from county_sales "
            f"where {'true' if county != 'null' else NO_FOURTH} and {test} "
            f"{'group by ' + ', '.join(keys) if keys else 'having count(*) > 0'}) {y}_n on "
            + (" and ".join(f"k.{c} = {y}_n.{c}" for c in keys) or "true")
            for y, (test, _, _) in YEAR_PARTS.items()
        )
        parts.append(
            f"""select '{grain}' as grain, {'k.County' if county != 'null' else 'null'} as County,
  {'k.PropertyType' if kind != 'null' else 'null'} as PropertyType, cy_n.n as cy_sales_count,
  cy_ppf_{g}.v as cy_price_per_foot, cy_med_{g}.v as cy_MedianPrice, py_n.n as py_sales_count,
  py_med_{g}.v as py_MedianPrice, cy_inv_{g}.n as inv_cy, cy_sold_{g}.n as sold_cy
from ({known}) k {counts} {join(f'cy_ppf_{g}')} {join(f'cy_med_{g}')} {join(f'py_med_{g}')}
{join(f'cy_inv_{g}')} {join(f'cy_sold_{g}')}"""
        )
    return f"with {', '.join(county_ctes('true', True))}\n" + "\nunion all\n".join(parts)


def custom_geo() -> str:
    base = f"""select l.*, cust.custom_geo from listings l {GEO}
join listings_custom_geo cust on cust.listing_key = l.listing_key
  and cust.source_system_id = l.source_system_id and cust.lakefront_flag = 1
join (select distinct custom_geo from listings_custom_geo
  where lower(custom_geo) like '%lakefront%') m on cust.custom_geo = m.custom_geo
where l.close_date is not null and l.property_type = 'Residential'"""
    limited = base.replace(
        "where l.close_date",
        f"join (values {', '.join(f'({quoted([s])})' for s in Q.SUBTYPES.split(','))}) v(item) "
        "on l.property_sub_type = v.item where l.close_date",
    )
    return f"""with rpt as ({sales('custom_geo', limited, base)})
select * from rpt
union all
select cg.custom_geo, cg.Qtr, cg.Yr, 0, 0, 0, 0, 0, 0 from (
  select g.custom_geo, p.Qtr, p.Yr from (select distinct custom_geo from listings_custom_geo
    where lower(custom_geo) like '%lakefront%') g
  cross join (select distinct Yr, Qtr from rpt) p) cg
left join rpt r on cg.custom_geo = r.custom_geo and cg.Yr = r.Yr and cg.Qtr = r.Qtr
where r.custom_geo is null"""


def towns() -> str:
    kept = f"property_sub_type in ({quoted(K.PROPERTY_SUBTYPES)})"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in Q.TOWNS)
    shared = f"""select l.*, cust.custom_geo from listings l {GEO}
join listings_custom_geo cust on cust.listing_key = l.listing_key
  and cust.source_system_id = l.source_system_id
where cust.custom_geo in ({quoted(Q.COMMUNITIES)}) and l.close_date is not null
  and l.property_type = 'Residential' and {kept}"""
    place = f"""select * from ({CLOSED_TOWN}) c where source_system_id = 10
and census_place in ({quoted(Q.PLACES)}) and {kept}"""
    town = f"""select c.* from ({CLOSED_TOWN}) c join (values {pairs}) v(muni, kind)
on c.municipality = v.muni and c.municipality_type = v.kind where {kept}"""
    metrics = "Qtr, Yr, price_per_foot, sales_volume, sales_count, avg_sale, avg_dom, MedianPrice"
    return f"""select municipality as Municipality, municipality_type as MunicipalityType, {metrics}
from ({sales('municipality, municipality_type', town)}) a
union all
select custom_geo, null, {metrics} from ({sales('custom_geo', shared)}) b
union all
select census_place, null, {metrics} from ({sales('census_place', place)}) c"""


def share(with_band: bool, strict: bool = True) -> str:
    own = "" if strict else " and lcv.source_system_id = {0}.source_system_id"
    rows = "\nunion all\n".join(
        f"""select {COUNTY} as County, case
  when oc.office_name like 'Supplier#00000000%' then 'First Ten'
  when oc.office_name like '%5' then 'Fives'
  when oc.office_name like '%#0000000_2%' then 'Twenties' else 'Other' end as Company,
  lcv.close_date, lcv.sides, lcv.volume_credit,
  {band('lcv.list_price', K.BREAKS_5, 5)} as listpricebucket
from listing_sides lcv join listings lc on lcv.listing_key = lc.listing_key{own.format('lc')}
join offices oc on lcv.office_key = oc.office_key
join listings_geo g on lcv.listing_key = g.listing_key{own.format('g')} {NAMES}
where lcv.source_system_id = {source} and lcv.close_date is not null
  and year(lcv.close_date) > 1996 and {COUNTY} in ({quoted(counties)})
  and lcv.property_type = 'Residential'"""
        for source, counties in ((1, Q.TRI), (10, (Q.FOURTH,)))
    )
    keys = "County, listpricebucket" if with_band else "County"
    same = "lbc.County = tl.County and lbc.date_qtr = tl.date_qtr and lbc.date_year = tl.date_year"
    text = ""
    if with_band:
        same += " and lbc.listpricebucket = tl.listpricebucket"
        text = f"{band_text('lbc.listpricebucket', K.BREAKS_5)} as listpricebuckettext,"
    quarter = "quarter(close_date) as date_qtr, year(close_date) as date_year"
    sums = "sum(sides) as SidesCount, sum(volume_credit) as VolumeTotal"
    group = f"{keys}, quarter(close_date), year(close_date)"
    return f"""with lcc as ({rows}),
tl as (select {keys}, {quarter}, {sums} from lcc group by {group}),
lbc as (select {keys}, Company, {quarter}, {sums} from lcc group by {group}, Company)
select lbc.*, {text} {real('lbc.SidesCount', 'tl.SidesCount')} * 100 as SidesMarketShare,
  {real('lbc.VolumeTotal', 'tl.VolumeTotal')} * 100 as VolumeMarketShare
from lbc join tl on {same}
order by date_year, date_qtr, lbc.SidesCount desc"""


PERIODS = {
    "ytdClosed": ("close_date", CY_FROM, CY_TO, "close_price"),
    "ytdUC": ("contract_date", CY_FROM, CY_TO, "list_price"),
    "pytdClosed": ("close_date", PY_FROM, PY_TO, "close_price"),
    "pytdUC": ("contract_date", PY_FROM, PY_TO, "list_price"),
}
UNIT_METRICS = (
    "count(*) as NoUnits, {price} as AvgPrice, "
    + whole_avg(days("list_date", "contract_date")) + " as avg_DOM"
)


def period_sides(date_column: str, start: str, end: str) -> str:
    return "\nunion all\n".join(
        f"""select o.office_name, o.company, o.office_mls_id, o.office_city,
  {PREFIX} as FirmPrefix, lt.* from broker_listings lt join broker_offices o on lt.{role} = o.office_key
where lt.{date_column} > {start} and lt.{date_column} < {end}"""
        for role in ("list_office_key", "buyer_office_key")
    )


def broker_towns() -> str:
    ctes, parts = [], []
    for name, (column, start, end, price) in PERIODS.items():
        ctes += [
            f"{name} as ({period_sides(column, start, end)})",
            f"{name}_total as (select ct.tab_name, count(*) as TotalUnits from {name} "
            f"join custom_tabs ct on {name}.town = ct.service_area group by ct.tab_name)",
        ]
        parts.append(
            f"""select '{name}' as GroupType, a.*,
  cast(NoUnits as double) / cast(tu.TotalUnits as double) as PercUnits,
  dense_rank() over (partition by a.TabName order by NoUnits desc) as OfficeRank
from (select ct.tab_name as TabName, coalesce(company, office_name) as Broker,
    office_mls_id as MLSID, {UNIT_METRICS.format(price=money_avg(price))}
  from {name} join custom_tabs ct on {name}.town = ct.service_area
  group by ct.tab_name, coalesce(company, office_name), office_mls_id) a
join {name}_total tu on a.TabName = tu.tab_name"""
        )
    return f"""with {', '.join(ctes)},
temp_towns as (select rpt.*, tt.TabHeader, tt.message_text
  from ({' union all '.join(parts)}) rpt join ({TAB_TEXT}) tt on rpt.TabName = tt.TabName)
select distinct t.* from temp_towns t join (
  select TabName, GroupType, OfficeRank from temp_towns
  where MLSID = right(TabHeader, 6) or MLSID = right(substr(TabHeader, 1,
    case instr(TabHeader, '/') when 0 then length(TabHeader) else instr(TabHeader, '/') - 1 end), 6)) a
on t.TabName = a.TabName and t.GroupType = a.GroupType
where t.OfficeRank <= case when a.OfficeRank > 5 then a.OfficeRank else 5 end"""


def firm_ranking(tabs: str, match: str, own: str, total_by_town: tuple = ()) -> str:
    ctes, parts = [f"firms as ({FIRMS})", f"tabs as ({tabs})"], []
    for name, (column, start, end, price) in PERIODS.items():
        total = (
            f"join custom_tabs ct on {name}.town = ct.service_area"
            if name in total_by_town else f"join tabs ct on {match.format(name)}"
        )
        ctes += [
            f"{name} as ({period_sides(column, start, end)})",
            f"{name}_total as (select ct.tab_name, count(*) as TotalUnits from {name} {total} "
            "group by ct.tab_name)",
        ]
        for level in ("firm", "office"):
            office = "office_city, office_mls_id"
            shown = (
                "office_city as OfficeCity, office_mls_id as MLSID" if level == "office"
                else "cast(null as varchar) as OfficeCity, cast(null as varchar) as MLSID"
            )
            rank = "dense_rank() over (partition by a.TabName order by NoUnits desc)"
            ranks = (
                f"{rank} as FirmRank, cast(null as bigint) as OfficeRank" if level == "firm"
                else f"cast(null as bigint) as FirmRank, {rank} as OfficeRank"
            )
            parts.append(
                f"""select '{name}' as GroupType, a.*,
  cast(NoUnits as double) / cast(tu.TotalUnits as double) as PercUnits, {ranks}
from (select ct.tab_name as TabName, fx.FirmPrefix, fx.Firm, {shown},
    {UNIT_METRICS.format(price=money_avg(price))}
  from {name} join tabs ct on {match.format(name)}
  left join firms fx on {name}.FirmPrefix = fx.FirmPrefix
  group by ct.tab_name, fx.FirmPrefix, fx.Firm{', ' + office if level == 'office' else ''}) a
join {name}_total tu on a.TabName = tu.tab_name"""
            )
    return f"""with {', '.join(ctes)},
temp_firms as (select rpt.*, tt.TabHeader, tt.message_text
  from ({' union all '.join(parts)}) rpt join ({TAB_TEXT}) tt on rpt.TabName = tt.TabName),
top_firms as (select t.GroupType, t.TabName, t.FirmPrefix from temp_firms t join (
  select distinct TabName, GroupType, FirmPrefix, FirmRank from temp_firms
  where lower(FirmPrefix) = '{own}' and FirmRank is not null) a
  on t.TabName = a.TabName and t.GroupType = a.GroupType
  where t.FirmRank <= case when a.FirmRank > 5 then a.FirmRank else 5 end)
select distinct t.* from temp_firms t join top_firms g
on t.GroupType = g.GroupType and t.TabName = g.TabName and t.FirmPrefix = g.FirmPrefix"""


def firm_counties(own: str) -> str:
    return firm_ranking(
        "select distinct tab_name from custom_tabs where tab_type = 'County'",
        "{0}.county_or_parish = ct.tab_name", own,
    )


def firm_zones(strict: bool = True) -> str:
    return firm_ranking(
        "select distinct tab_name, substr(tab_name, instr(tab_name, ' ') + 1) as zone "
        "from custom_tabs where tab_type = 'Zone'",
        "{0}.zone = ct.zone", Q.OWN_PREFIX, ("ytdUC", "pytdClosed", "pytdUC") if strict else (),
    )


def firm_lines() -> str:
    """The lines of each period numbered by themselves, and then put beside each other."""
    columns = ", ".join(
        f"max(case when GroupType = '{p}' then {value} end) as {p}_{name}"
        for p in PERIODS_SHOWN for name, value in LINE_COLUMNS.items()
    )
    return f"""with r as ({firm_counties(Q.OWN_PREFIX)}),
f as (select *, max(FirmRank) over (partition by TabName, GroupType, FirmPrefix) as fr from r),
l as (select *, row_number() over (partition by TabName, GroupType order by fr, FirmPrefix, OfficeRank nulls first,
  OfficeCity nulls first, MLSID nulls first) as Line from f)
select TabName, Line, {columns} from l group by TabName, Line"""


PERIODS_SHOWN = ("ytdClosed", "ytdUC", "pytdClosed", "pytdUC")
LINE_COLUMNS = {
    "Rank": "coalesce(FirmRank, OfficeRank)", "Name": "coalesce(OfficeCity, Firm)", "NoUnits": "NoUnits",
    "PercUnits": "PercUnits", "AvgPrice": "AvgPrice", "avg_DOM": "avg_DOM",
}
_LINE_SPEC = "TabName:s Line:i " + " ".join(
    f"{p}_Rank:i {p}_Name:s {p}_NoUnits:i {p}_PercUnits:d {p}_AvgPrice:d {p}_avg_DOM:i" for p in PERIODS_SHOWN
)


def curve(rows: str, keys: str, first, last, step: str) -> str:
    """Every listing tested on every day shown."""
    same = " and ".join(f"a.{k} = h.{k}" for k in keys.split(", "))
    return f"""with src as ({rows}),
days as (select unnest(generate_series(date '{first}', date '{last}', interval 1 day)) as ts),
every_day as (select cast(ts as date) as d from days),
hits as (select {keys}, d, count(*) as n from src join every_day on {on_market('d')} group by {keys}, d),
places as (select distinct {keys} from hits)
select {", ".join(f"a.{k}" for k in keys.split(", "))}, e.d as Day, coalesce(h.n, 0) as ActiveListings
from places a cross join every_day e left join hits h on {same} and h.d = e.d
where cast(date_trunc('{step}', e.d) as date) = e.d"""


def area_curve() -> str:
    columns = "l.standard_status, l.list_date, l.close_date, l.status_date"
    return curve(area_union(QUARTERLY_AREAS, columns), "Area", *Q.CURVE_DAYS, "day")


def county_curve() -> str:
    rows = county_work("l.*", "'Residential', 'Land'", Q.TRI, Q.FOURTH)
    return curve(f"select *, {CLASS} as PropertyType from ({rows}) w", "County, PropertyType", *Q.CURVE_MONTHS, "month")


def area_yoy() -> str:
    def change(column: str) -> str:
        whole = "coalesce(round_even(cast({0}.{1} as double), 0), 0)"
        now, before = whole.format("r", column), whole.format("p", column)
        return f"case when p.Area is not null then ({now} - {before}) / nullif({before}, 0) end as {column}_change"

    columns = ["sales_count", "avg_DOM", "MedianPrice", "ActiveListings"]
    return f"""with report as ({market_area()})
select r.Area, r.Qtr, r.Yr, {', '.join(f'r.{c}' for c in columns)}, {', '.join(map(change, columns))}
from report r left join report p on r.Area = p.Area and r.Qtr = p.Qtr and p.Yr = r.Yr - 1 and p.Yr >= 2000 - 1
where r.Yr >= 2000 - 1 and r.Yr <= 2000 and r.Qtr = 2"""


def price_point_yoy() -> str:
    measures = ("total_listings", "total_sold", "total_volume_sold", "months_inventory")
    sums, columns = [], []
    for m in measures:
        for tag, year in (("py", 1999), ("cy", 2000)):
            sums.append(f"sum(case when Yr = {year} then cast({m} as double) end) as {tag}_{m}")
            columns.append(f"coalesce({tag}_{m}, 0) as {tag}_{m}")
        columns.append(
            f"case when coalesce(py_{m}, 0) = 0 then null "
            f"else (coalesce(cy_{m}, 0) - py_{m}) / py_{m} end as {m}_change"
        )
    return f"""select area, listpricebucket, {', '.join(columns)} from (
select area, listpricebucket, {', '.join(sums)} from ({price_range_area()}) r
group by area, listpricebucket) w"""


_RANK_SPEC = "NoUnits:i AvgPrice:d avg_DOM:i PercUnits:d"
_FIRM_SPEC = (
    f"GroupType:s TabName:s FirmPrefix:s Firm:s OfficeCity:s MLSID:s {_RANK_SPEC} "
    "FirmRank:i OfficeRank:i TabHeader:s message_text:s"
)
_BAND_SPEC = "total_listings:i avg_DOM:i total_sold:i total_volume_sold:d months_inventory:r"


def _county_spec(extra: bool) -> str:
    spec = []
    for word in ("Current", "Previous"):
        spec += [
            f"{word}YearSalesCount:i", f"{word}PricePerFoot:r", f"{word}TriCountyPricePerFoot:r",
            f"{word}SalesVolume:d", f"{word}AvgSale:d", f"{word}AvgDOM:i", f"{word}MedianPrice:d",
            f"{word}TriCountyMedian:d",
        ]
        if extra:
            spec += [
                f"{word}AllUnitTypesPricePerFoot:r", f"{word}TriCountyPricePerFootAllUnitTypes:r",
                f"{word}AllUnitTypesMedian:d", f"{word}MedianTriCountyAllUnitTypes:d",
            ]
    kinds_ = ["", "TriCounty_"] + (["AllUnitTypes_", "TriCountyAllUnitTypes_"] if extra else [])
    spec += [f"{y}_{k}months_inventory:d" for y in ("cy", "py") for k in kinds_]
    return " ".join(spec)


OPERATORS |= {
    "supply_demand": typed(
        supply_demand("date '1999-03-01'", "date '1998-09-01'", "date '1999-02-28'", 1999, K.BREAKS_5),
        "Area:s Sort:i ListPriceBucket:s ActiveListings:i Sold_Prior6Months:i AvgDOM:i",
    ),
    "grouping_sets_stats": typed(
        grouping_sets(),
        "grain:s County:s PropertyType:s cy_sales_count:i cy_price_per_foot:r cy_MedianPrice:d "
        "py_sales_count:i py_MedianPrice:d inv_cy:i sold_cy:i",
    ),
    "firm_office_rank": typed(firm_counties("bre"), _FIRM_SPEC),
}

REPORTS = {
    "inventory_curve": typed(area_curve(), "Area:s Day:s ActiveListings:i"),
    "inventory_months": typed(county_curve(), "County:s PropertyType:s Day:s ActiveListings:i"),
    "rpt_market_area": typed(
        market_area(),
        "Area:s Qtr:i Yr:i price_per_foot:r sales_volume:d sales_count:i avg_sale:d MedianPrice:d "
        "ActiveListings:i avg_DOM:d",
    ),
    "rpt_price_range_area": typed(price_range_area(), f"Yr:i area:s listpricebucket:s {_BAND_SPEC}"),
    "rpt_supply_demand_sql": typed(
        supply_demand(EVAL, "date '2000-01-01'", "date '2000-06-30'", 2000, K.BREAKS_16),
        "Area:s Sort:i ListPriceBucket:s ActiveListings:i Sold_Prior6Months:i AvgDOM:i",
    ),
    "rpt_supply_demand": typed(
        supply_demand(EVAL, "date '2000-01-01'", "date '2000-06-30'", 2000, K.BREAKS_16),
        "Area:s Sort:i ListPriceBucket:s ActiveListings:i Sold_Prior6Months:i AvgDOM:i",
    ),
    "rpt_price_range_county": typed(
        price_range_county(), f"Yr:i county:s listpricebucket:s {_BAND_SPEC}"
    ),
    "suite_county_class": typed(county_class(), "PropertyType:s County:s " + _county_spec(True)),
    "suite_county_all": typed(county_all(), "County:s " + _county_spec(False)),
    "suite_county_level": typed(
        sales("PropertyType, County", COUNTY_SALES), "PropertyType:s County:s " + SALES_SPEC
    ),
    "suite_price_range_county": typed(
        price_range_county(Q.SCOPE), f"Yr:i county:s listpricebucket:s {_BAND_SPEC}"
    ),
    "rpt_county_class": typed(county_class(), "PropertyType:s County:s " + _county_spec(True)),
    "rpt_county_all": typed(county_all(), "County:s " + _county_spec(False)),
    "rpt_custom_geo": typed(custom_geo(), "custom_geo:s " + SALES_SPEC),
    "rpt_towns": typed(towns(), "Municipality:s MunicipalityType:s " + SALES_SPEC),
    "rpt_share_company": typed(
        share(False),
        "County:s Company:s date_qtr:i date_year:i SidesCount:d VolumeTotal:d SidesMarketShare:r "
        "VolumeMarketShare:r",
    ),
    "rpt_share_price_range": typed(
        share(True),
        "County:s listpricebucket:i Company:s date_qtr:i date_year:i SidesCount:d VolumeTotal:d "
        "listpricebuckettext:s SidesMarketShare:r VolumeMarketShare:r",
    ),
    "rpt_broker_towns": typed(
        broker_towns(),
        f"GroupType:s TabName:s Broker:s MLSID:s {_RANK_SPEC} OfficeRank:i TabHeader:s message_text:s",
    ),
    "rpt_firm_counties": typed(firm_counties(Q.OWN_PREFIX), _FIRM_SPEC),
    "rpt_firm_zones": typed(firm_zones(), _FIRM_SPEC),
    "rpt_municipality": typed(
        sales(
            "Municipality, MunicipalityType",
            f"""select listing_key, list_date, close_date, close_price, building_area,
  municipality as Municipality, municipality_type as MunicipalityType from ({CLOSED_TOWN}) c
where property_sub_type in ({quoted(Q.SUBTYPES.split(','))})""",
        ),
        "Municipality:s MunicipalityType:s " + SALES_SPEC,
    ),
    "rpt_county_level": typed(
        sales("PropertyType, County", COUNTY_SALES), "PropertyType:s County:s " + SALES_SPEC
    ),
    "rpt_county_level_clustered": typed(
        f"""select * from ({sales("PropertyType, County", COUNTY_SALES)}) r
where (Yr = 1999 or Yr = 2000) and Qtr = 2""",
        "PropertyType:s County:s " + SALES_SPEC,
    ),
    "rpt_county_level_stored": typed(
        sales("PropertyType, County", COUNTY_SALES), "PropertyType:s County:s " + SALES_SPEC
    ),
    "rpt_county_class_corrected": typed(county_class(False), "PropertyType:s County:s " + _county_spec(True)),
    "rpt_county_all_corrected": typed(county_all(False), "County:s " + _county_spec(False)),
    "rpt_share_company_corrected": typed(
        share(False, False),
        "County:s Company:s date_qtr:i date_year:i SidesCount:d VolumeTotal:d SidesMarketShare:r "
        "VolumeMarketShare:r",
    ),
    "rpt_firm_zones_corrected": typed(firm_zones(False), _FIRM_SPEC),
    "rpt_county_level_quarters": typed(
        f"""select * from ({sales("PropertyType, County", COUNTY_SALES)}) r
where (Yr = 1999 or Yr = 2000) and Qtr = 2""",
        "PropertyType:s County:s " + SALES_SPEC,
    ),
    "view_area_yoy": typed(
        area_yoy(),
        "Area:s Qtr:i Yr:i sales_count:i avg_DOM:d MedianPrice:d ActiveListings:i "
        "sales_count_change:d avg_DOM_change:d MedianPrice_change:d ActiveListings_change:d",
    ),
    "view_price_point_yoy": typed(
        price_point_yoy(),
        "area:s listpricebucket:s "
        + " ".join(
            f"py_{m}:{k} cy_{m}:{k} {m}_change:d"
            for m, k in (
                ("total_listings", "i"), ("total_sold", "i"), ("total_volume_sold", "d"),
                ("months_inventory", "d"),
            )
        ),
    ),
    "view_firm_lines": typed(firm_lines(), _LINE_SPEC),
    "view_firm_display": typed(
        f"""select TabName, GroupType, FirmRank, OfficeRank,
  case when OfficeCity is null then Firm else OfficeCity end as DisplayName, MLSID, NoUnits,
  PercUnits, AvgPrice, avg_DOM from ({firm_counties(Q.OWN_PREFIX)}) r""",
        "TabName:s GroupType:s FirmRank:i OfficeRank:i DisplayName:s MLSID:s " + _RANK_SPEC,
    ),
}
