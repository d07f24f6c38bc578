"""Listing tables derived from the supplied tables, as SQL both engines run unchanged.

Curly names stand for other tables. Spark fills them with DataFrames, the SQL check with
names of common table expressions.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

_SOURCE = "case o_custkey % 4 when 0 then 1 when 1 then 4 when 2 then 8 else 10 end"
_SOLD = "o_orderkey % 20 < 8 or o_orderkey % 20 = 18"
_LIST_DATE = "cast(o_orderdate as date)"
_CLOSE_DATE = f"case when {_SOLD} then {_LIST_DATE} + cast(o_orderkey % 181 as int) end"
_CONTRACT_DATE = f"{_LIST_DATE} + cast(o_orderkey % 61 as int)"
_LIST_PRICE = "cast(cast(o_totalprice as decimal(18,2)) + (o_orderkey % 7) * 1000 as decimal(18,2))"
_CLOSE_PRICE = f"case when {_SOLD} then cast(o_totalprice as decimal(18,2)) end"
_LIST_OFFICE = "o_custkey % 89"
_BUYER_OFFICE = "case when o_orderkey % 11 <> 0 then (o_orderkey * 7 + 3) % 97 end"
_AREA = (
    "case when o_orderkey % 47 = 0 then 'Unknown' "
    "else concat(cast(n_nationkey + 11 as varchar(10)), ' - ', n_name) end"
)
_PLACED = (
    "from {orders} join {customer} on o_custkey = c_custkey "
    "join {nation} on c_nationkey = n_nationkey"
)

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders")

VIEWS = {
    "listings": f"""
select o_orderkey as listing_key, {_SOURCE} as source_system_id,
  case when o_orderkey % 20 < 9 then 'Closed' when o_orderkey % 20 < 11 then 'Active'
       when o_orderkey % 20 = 11 then 'Active Under Contract' when o_orderkey % 20 < 14 then 'Expired'
       when o_orderkey % 20 = 14 then 'Pending' when o_orderkey % 20 < 17 then 'Withdrawn'
       when o_orderkey % 20 < 19 then 'Canceled' else 'Coming Soon' end as standard_status,
  case when o_orderkey % 17 < 13 then 'Residential' when o_orderkey % 17 < 16 then 'Land'
       else 'Commercial' end as property_type,
  case o_orderpriority when '1-URGENT' then 'Condominium' when '2-HIGH' then 'Duplex'
       when '3-MEDIUM' then 'Single Family Residential'
       when '4-NOT SPECIFIED' then 'Townhouse' end as property_sub_type,
  {_LIST_DATE} as list_date, {_CONTRACT_DATE} as contract_date, {_CLOSE_DATE} as close_date,
  {_LIST_DATE} + cast((o_orderkey * 7) % 239 as int) as status_date,
  {_LIST_PRICE} as list_price, {_CLOSE_PRICE} as close_price,
  case when o_orderkey % 23 = 0 then 0 when o_orderkey % 23 = 1 then null
       else 600 + o_orderkey % 3401 end as building_area,
  {_LIST_OFFICE} as list_office_key, {_BUYER_OFFICE} as buyer_office_key
from {{orders}}""",
    "listings_geo": f"""
select o_orderkey as listing_key, {_SOURCE} as source_system_id,
  n_nationkey as county_fp, n_regionkey as state_fp, n_name as municipality,
  case o_orderkey % 3 when 0 then 'C' when 1 then 'T' else 'V' end as municipality_type,
  concat('Place ', cast(o_orderkey % 13 as varchar(10))) as census_place
{_PLACED}""",
    "area_listings": f"""
select o_orderkey as listing_key, {_SOURCE} as source_system_id,
  {_LIST_DATE} as list_date, {_CLOSE_DATE} as close_date, {_AREA} as area,
  case when o_orderkey % 37 = 0 then 'South of Broad' end as subdivision,
  n_name as county_or_parish
{_PLACED}""",
    "county_names": """
select n_nationkey as county_fp, n_regionkey as state_num,
  concat(n_name, ' County') as county_name, n_name as county from {nation}""",
    "county_by_region": """
select r_name as region, n_name as county from {nation} join {region} on n_regionkey = r_regionkey
union all
select 'SECOND' as region, n_name as county from {nation} where n_nationkey % 5 = 0""",
    "listings_custom_geo": f"""
select o_orderkey as listing_key, {_SOURCE} as source_system_id,
  concat('Lake ', cast(o_orderkey % 9 as varchar(10)),
         case when o_orderkey % 9 = 8 then ' Resort' else ' Lakefront' end) as custom_geo,
  case when o_orderkey % 2 = 0 then 1 else 0 end as lakefront_flag
from {{orders}}""",
    "listing_sides": """
select listing_key, source_system_id, list_office_key as office_key, close_date, close_price,
  list_price, property_type, cast(1 as decimal(9,2)) as sides, close_price as volume_credit
from {listings} where close_date is not null
union all
select listing_key, source_system_id, buyer_office_key as office_key, close_date, close_price,
  list_price, property_type, cast(1 as decimal(9,2)) as sides, close_price as volume_credit
from {listings} where close_date is not null and buyer_office_key is not null""",
    "offices": "select s_suppkey as office_key, s_name as office_name from {supplier}",
    "broker_listings": f"""
select {_LIST_OFFICE} as list_office_key, {_BUYER_OFFICE} as buyer_office_key,
  {_LIST_DATE} as list_date, {_CONTRACT_DATE} as contract_date, {_CLOSE_DATE} as close_date,
  {_LIST_PRICE} as list_price, {_CLOSE_PRICE} as close_price, n_name as town,
  n_name as county_or_parish, cast(n_regionkey + 1 as varchar(10)) as zone
{_PLACED}""",
    "broker_offices": """
select s_suppkey as office_key, s_name as office_name,
  case when s_suppkey % 3 <> 0 then concat('Firm ', cast(s_suppkey % 5 as varchar(10))) end as company,
  case when s_suppkey = 9 then 'NODIGIT'
       else concat(substr('ABCDE', cast(s_suppkey % 5 as int) + 1, 1), 'RE',
                   lpad(cast(s_suppkey as varchar(10)), 3, '0')) end as office_mls_id,
  concat('City ', cast(s_suppkey % 4 as varchar(10))) as office_city
from {supplier}""",
    "custom_tabs": """
select concat('Town ', r_name) as tab_name, 'Town' as tab_type,
  concat(r_name, ' ARE000') as tab_header, n_name as service_area
from {nation} join {region} on n_regionkey = r_regionkey
union all
select n_name as tab_name, 'County' as tab_type, concat(n_name, ' ARE000/BRE001') as tab_header,
  n_name as service_area from {nation}
union all
select concat('Zone ', cast((n_regionkey + n_nationkey) % 5 + 1 as varchar(10))) as tab_name,
  'Zone' as tab_type, 'Zone ARE000' as tab_header, n_name as service_area from {nation}""",
    "property_subtypes": "select property_sub_type from {listings}",
}


def needs(text: str) -> list[str]:
    """Tables a text reads, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class SampleTables(dict):
    """The supplied tables and the listing tables derived from them, defined on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            table = self.spark.sql(text, **{t: self[t] for t in needs(text)})
        else:
            table = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        self[name] = table
        return table


def load(spark: SparkSession, sf_dir: str) -> SampleTables:
    return SampleTables(spark, sf_dir)


def as_sql(body: str) -> str:
    """``body`` with the views it reads as common table expressions."""
    ordered: list[str] = []

    def visit(names: list[str]) -> None:
        for name in names:
            if name in VIEWS and name not in ordered:
                visit(needs(VIEWS[name]))
                ordered.append(name)

    visit(re.findall(r"\w+", body))
    views = [f"{name} as ({re.sub(r'[{}]', '', VIEWS[name])})" for name in ordered]
    text = body.strip()
    if not views:
        return text
    if text.lower().startswith("with "):
        return "with " + ",\n".join(views) + ",\n" + text[5:]
    return "with " + ",\n".join(views) + "\n" + text
