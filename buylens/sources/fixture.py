"""Shape star-schema tables (orders, lineitem, part, supplier ...) into purchasing tables.

Amounts stay integers (cents, hundredths of a unit) until the last cast, so the result
does not depend on the order of additions.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.schemas import SCHEMAS
from buylens.session import shared_folder, tune

# Fixed values of the fixture.
COUNTRIES = ["JP", "CN", "KR", "TW", "SG", "MY", "VN", "DE", "US", "TH"]
CURRENCIES = ["JPY", "CNY", "KRW", "TWD", "SGD", "MYR", "VND", "EUR", "USD", "THB"]
TERMS = ["NET30", "NET60", "NET90", "2/10NET30"]
VENDOR_TYPES = ["OEM", "DISTRIBUTOR", "CONTRACT_MFG", "LOGISTICS", "SERVICE"]
REASONS = ["DEFECTIVE", "DAMAGED", "EXPIRED", "WRONG_ITEM"]
TOP_CATEGORY = {"SMALL": "ELEC", "MEDIUM": "MECH", "LARGE": "MOTN", "ECONOMY": "MRO", "PROMO": "SRVC",
                "STANDARD": "PACK"}
MATERIAL_TYPE = {"MEDIUM": "RAW", "LARGE": "ASSEMBLY", "ECONOMY": "MRO", "PROMO": "SERVICE"}
OWNERS = [("ELEC", "PG01", "Electronics", "PO01"), ("MECH", "PG02", "Mechanics", "PO01"),
          ("MOTN", "PG03", "Motion", "PO01"), ("MRO", "PG04", "Maintenance", "PO02"),
          ("SRVC", "PG05", "Services", "PO02"), ("PACK", "PG06", "Packaging", "PO02")]


def _pick(values: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


def _case(mapping: dict[str, str], column: str, other: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"case {column} {arms} else {other} end"


def _vendor_terms(nation: str, sk: str) -> list[str]:
    """What a vendor's number and nation decide."""
    return [f"{_pick(COUNTRIES, f'{nation} % 10')} as country", f"{_pick(CURRENCIES, f'{nation} % 10')} as currency",
            f"{_pick(TERMS, f'{sk} % 4')} as payment_terms", f"{_pick(['FOB', 'CIF', 'EXW'], f'{sk} % 3')} as incoterms"]


def _with_vendor(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their vendor, as an inner join gives them: one row for each vendor row of the number, none without."""
    names = ("country", "currency", "payment_terms", "incoterms")
    found = rows.selectExpr("*", "inline(nations)")
    return found.selectExpr("*", *[e for n, e in zip(names, _vendor_terms("nation", "sk")) if n in columns]).drop("nation")


def _money(cents: str, precision: int = 14) -> str:
    return f"cast(({cents}) / 100 as decimal({precision},2))"


#: Tables that cost a join on rows, a window or a distinct, or hold rows of the driver. They are written once, with few and narrow columns;
#: all others are projections and filters of them or of the given files, and take no space.
WRITTEN = {"ordered", "requested", "stocked", "lanes", "agreements", "owners", "vendor_category", "category_hierarchy", "company_code",
           "purchasing_org", "purchasing_group", "plant"}


#: Bytes of the order lines' files that one shuffle partition answers for, and of compressed shuffled rows that AQE puts into one task: a line
#: grows some twenty times while it is sorted, and two sorts in a row hold it at once.
PARTITION_BYTES, TASK_BYTES = 2 << 20, 16 << 20


def dealt_by_size(spark: SparkSession, source_dir: str) -> None:
    """As many shuffle partitions to begin with as the order lines need, so that a task's rows are sorted in memory; AQE puts small ones together again.

    A session that asks for more partitions or smaller tasks keeps what it asks for. Small tables change nothing.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{source_dir}/lineitem.parquet")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return
    wanted = -(-store.getContentSummary(path).getLength() // PARTITION_BYTES)
    first, task = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if wanted > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(wanted))
        if spark.conf.get(task).rstrip("b") == str(64 << 20):
            spark.conf.set(task, f"{TASK_BYTES}b")


class PurchasingTables:
    """Mapping from table name to DataFrame; what is costly to derive is written once and then read back.

    Without a shared folder the tables stay plain query plans over the given files.
    """

    def __init__(self, spark: SparkSession, source_dir: str, materialize: bool = True):
        self.spark, self.source_dir = spark, source_dir.rstrip("/")
        folder = shared_folder(spark) if materialize else None
        # Each mapping writes in a folder of its own: another one of the same session may still read its files.
        tag = hashlib.sha1(f"{spark.sparkContext.applicationId}{self.source_dir}{uuid.uuid4().hex}".encode()).hexdigest()[:12]
        self._folder = f"{folder}/purchasing-{tag}" if folder else None
        self._frames: dict[str, DataFrame] = {}
        self.kept: set[str] = set()  # derived tables written beside the others

    @property
    def folder(self) -> str:
        """Where derived tables and outputs go; an error on a cluster without a shared folder."""
        if self._folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return self._folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.source_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            df = getattr(self, f"_{name}")()
            if name in SCHEMAS:
                df = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])
            self._frames[name] = self._saved(name, df) if self._folder and name in WRITTEN else df
        return self._frames[name]

    def _saved(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.kept.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, name: str) -> DataFrame:
        """The table from files of its own under ``folder``, for readers of files such as streams."""
        df = self[name]
        if name not in self.kept:
            df = self._frames[name] = self._saved(name, df)
        return df

    def __contains__(self, name: str) -> bool:
        return name in SCHEMAS

    def keys(self):
        return SCHEMAS.keys()

    # --- working tables -------------------------------------------------

    def _vendor_keys(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as sk", "concat('VND-', lpad(s_suppkey, 6, '0')) as vendor_id", "s_name",
            *_vendor_terms("s_nationkey", "s_suppkey"))

    def _part_keys(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as pk", "concat('MAT-', lpad(p_partkey, 8, '0')) as material_id", "p_name",
            f"{_case(TOP_CATEGORY, 'p_type', repr('PACK'))} as l1",
            f"{_case(MATERIAL_TYPE, 'p_type', repr('COMPONENT'))} as material_type",
            "replace(p_brand, 'Brand#', 'B') as brand", "p_size div 10 as band",
            "cast(round(p_retailprice * 100) as bigint) * 5 as standard_c",
        )

    def _ordered(self) -> DataFrame:
        """One row per ordered line with keys, quantities and dates, and the sums of its order and of its invoice.

        Everything is computed on lines dealt out by order, which move once.
        """
        rest = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linenumber",
                "l_returnflag", "l_linestatus"]
        head = ["ok", "sk", "od", "ck", "o_orderpriority"]
        nations = self.raw("supplier").groupBy(F.col("s_suppkey").alias("sk")).agg(
            F.collect_list(F.struct(F.col("s_nationkey").alias("nation"))).alias("nations"))
        lines = (
            self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("line", 10 * F.row_number().over(W.partitionBy("l_orderkey", "l_suppkey").orderBy(*rest)))
            .withColumn("pr_line", 10 * F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_suppkey", *rest)))
            .selectExpr(
                "l_orderkey as ok", "l_suppkey as sk", "l_partkey as pk", "cast(l_quantity as bigint) as qty",
                "cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint) as price_c",
                "cast(o_orderdate as date) as od", "o_custkey as ck", "o_orderpriority", "line", "pr_line")
        )
        by_pair, by_order = W.partitionBy("ok", "sk"), W.partitionBy(*head)
        return (
            self._priced(self._derived(lines)).withColumns({
                "first_receipt": F.min("actual").over(by_pair),
                "gross_c": F.sum(F.expr("(inv_price_c * inv_h + 50) div 100")).over(by_pair),
                "price_bad": F.bool_or(F.expr("abs(inv_price_c - price_c) * 100 > price_c * 2 or abs(inv_price_c - price_c) > 50")).over(by_pair),
                "qty_bad": F.bool_or(F.expr("abs(inv_h - accepted_h) > qty * 5")).over(by_pair)})
            .withColumns({
                "heads_order": F.row_number().over(by_order.orderBy("line")) == 1,
                "total_c": F.sum(F.expr("qty * price_c")).over(by_order), "any_covered": F.bool_or("covered").over(by_order)})
            .select(*head, "pk", "qty", "price_c", "line", "pr_line", "first_receipt", "gross_c", "price_bad", "qty_bad",
                    "heads_order", "total_c", "any_covered")
            .join(nations, "sk", "left")
        )

    @staticmethod
    def _derived(lines: DataFrame) -> DataFrame:
        """Ordered lines with what follows from their own columns."""
        return lines.selectExpr(
            "*", "concat(lpad(ok, 8, '0'), '-', lpad(sk, 6, '0')) as doc", "concat('PR-', lpad(ok, 8, '0')) as pr_id",
            "concat('MAT-', lpad(pk, 8, '0')) as material_id", "concat('VND-', lpad(sk, 6, '0')) as vendor_id",
            "concat('PL0', ck % 5) as plant_id",
        ).selectExpr(
            "*", "concat('PO-', doc) as po_id", "concat('GR-', doc, '-', line) as gr_id",
            "(pk + sk) % 3 <> 0 and sk % 20 <> 3 and od between date'1995-06-01' and date'2001-05-31' as covered",
            "(ok + sk) % 12 <> 0 as received", "(ok + sk) % 12 <> 0 and (ok + sk) % 23 <> 0 as invoiced",
            "date_add(od, cast(7 + pk % 54 as int)) as requested",
            "date_add(od, cast(pk % 54 + (pk * 5 + ok * 3 + sk) % 21 - 2 as int)) as actual",
            "(pk * 13 + ok * 7 + line) % 100 as v",
            "qty * case (pk * 13 + ok * 7 + line) % 10 when 0 then 90 when 1 then 105 else 100 end as received_h",
            "if((pk + sk) % 8 = 0, qty * 5, 0L) as rejected_h",
        )

    @staticmethod
    def _priced(moves: DataFrame) -> DataFrame:
        """Moves with the price and quantity on their invoice."""
        return moves.selectExpr(
            "*",
            "case when v between 80 and 87 or v >= 97 then price_c * 105 div 100 "
            "when v between 88 and 91 then price_c * 92 div 100 else price_c end as inv_price_c",
            "received_h - rejected_h as accepted_h",
            "if(v >= 92, (received_h - rejected_h) * 108 div 100, received_h - rejected_h) as inv_h",
        )

    def _moves(self) -> DataFrame:
        return self._derived(self["ordered"])

    def _billed(self) -> DataFrame:
        """Invoiced lines before headers exist."""
        return self._priced(self["moves"].filter("invoiced"))

    def _bills(self) -> DataFrame:
        """One row per invoice, injected near-duplicates included; its sums stand on each of its lines."""
        sums = self["billed"].filter("line = 10").select(
            "doc", "ok", "sk", "po_id", "vendor_id", "first_receipt", "gross_c", "price_bad", "qty_bad", "nations")
        return (
            _with_vendor(sums, "payment_terms", "currency")
            .withColumn("copy", F.explode(F.expr("if(ok % 97 = 0, array('', 'D'), array(''))")))
            .selectExpr(
                "doc", "ok", "sk", "po_id", "vendor_id", "payment_terms", "currency", "gross_c", "price_bad",
                "qty_bad", "copy", "nations", "(gross_c * 7 + 50) div 100 as tax_c",
                "gross_c + (gross_c * 7 + 50) div 100 as net_c",
                "date_add(first_receipt, cast(1 + (ok + sk) % 5 + if(copy = 'D', 3, 0) as int)) as invoice_date",
                "case payment_terms when 'NET60' then 60 when 'NET90' then 90 else 30 end as days",
            )
        )

    def _paid(self) -> DataFrame:
        return (
            self["bills"].filter("not price_bad and not qty_bad and (ok + sk) % 9 <> 0")
            .withColumn("wait", F.expr("cast(days + (ok * 7 + sk) % 31 - 15 as int)"))
            .withColumn("discount_c",
                        F.expr("if(payment_terms = '2/10NET30' and wait <= 10, (net_c * 2 + 50) div 100, 0L)"))
        )

    # --- organisation and taxonomy --------------------------------------

    def _company_code(self):
        return self.spark.sql("select '1000' company_code, 'Example Robotics' company_name, 'SG' country, "
                              "'USD' currency")

    def _purchasing_org(self):
        return self.spark.createDataFrame(
            [("PO01", "Direct purchasing", "1000"), ("PO02", "Indirect purchasing", "1000")],
            SCHEMAS["purchasing_org"])

    def _purchasing_group(self):
        return self.spark.createDataFrame([(g, n, o, f"PG-{c}") for c, g, n, o in OWNERS],
                                          SCHEMAS["purchasing_group"])

    def _owners(self):
        owners = self.spark.createDataFrame([(c, g, n) for c, g, n, _ in OWNERS], "l1 string, grp string, name string")
        return owners.join(self["part_keys"].select("l1").distinct(), "l1", "left_semi")

    def _purchasing_group_category(self):
        return self["owners"].selectExpr("grp as purch_group_id", "l1 as category_id")

    def _plant(self):
        return self.raw("region").selectExpr(
            "concat('PL0', r_regionkey) as plant_id", "r_name as plant_name",
            f"{_pick(['SG', 'US', 'JP', 'DE', 'MY'], 'r_regionkey')} as country", "concat('City ', r_name) as city",
            f"{_pick(['ASSEMBLY', 'LOGISTICS'], 'r_regionkey % 2')} as function", "'1000' as company_code")

    def _storage_location(self):
        return self["plant"].selectExpr(
            "plant_id", "inline(array(struct('RAW' as storage_type, 'Raw store' as storage_loc_name), "
            "struct('FG' as storage_type, 'Finished goods' as storage_loc_name)))",
        ).withColumn("storage_loc_id", F.concat_ws("-", "plant_id", "storage_type"))

    def _cost_center(self):
        return self["plant"].selectExpr(
            "plant_id", "inline(array(struct('PRD' as code, 'Production' as department), "
            "struct('ENG' as code, 'Engineering' as department)))",
        ).selectExpr("concat('CC-', plant_id, '-', code) as cost_center_id",
                     "concat(department, ' ', plant_id) as cost_center_name", "plant_id", "department")

    def _category_hierarchy(self):
        parts = self["part_keys"]
        top = self["owners"].selectExpr("l1 as category_id", "name as category_name", "1 as level",
                                        "cast(null as string) as parent_category_id", "grp as owner_purch_group_id")
        middle = parts.select("l1", "brand").distinct().selectExpr(
            "concat_ws('-', l1, brand)", "concat_ws(' ', l1, brand)", "2", "l1", "cast(null as string)")
        leaf = parts.select("l1", "brand", "band").distinct().selectExpr(
            "concat(l1, '-', brand, '-S', band)", "concat(l1, ' ', brand, ' size ', band)", "3",
            "concat_ws('-', l1, brand)", "cast(null as string)")
        return top.union(middle).union(leaf)

    # --- materials and vendors ------------------------------------------

    def _material_master(self):
        return self["part_keys"].selectExpr(
            "material_id", "concat('M', pk) as display_code", "p_name as description", "material_type",
            "concat(l1, '-', brand, '-S', band) as category_id", "'EA' as base_uom",
            f"{_money('standard_c', 12)} as standard_cost", "'USD' as currency",
            "case when pk % 10 = 0 then 'HIGH' when pk % 10 < 3 then 'MEDIUM' else 'LOW' end as criticality",
            "case when pk % 10 = 0 then 'SAFETY' end as criticality_reason_code", "pk % 20 = 0 as hazmat_flag",
            "7 + pk % 54 as default_lead_time_days", "if(pk % 6 = 0, 'MAKE', 'BUY') as make_or_buy",
            "case when pk % 20 = 0 then 'RESTRICTED' when l1 in ('SRVC', 'PACK', 'MRO') then 'PUBLIC' "
            "else 'INTERNAL' end as confidentiality_tier")

    def _stocked(self):
        return self["ordered"].selectExpr("pk", "ck % 5 as plant").distinct()

    def _material_plant_extension(self):
        return self["stocked"].selectExpr(
            "concat('MAT-', lpad(pk, 8, '0')) as material_id", "concat('PL0', plant) as plant_id", "20 + pk % 80 as reorder_point", "10 + pk % 90 as lot_size",
            "1 + pk % 20 as min_order_qty")

    def _legal_entity(self):
        return self["vendor_keys"].filter("sk % 2 = 0").selectExpr(
            "concat('LE-', lpad(sk div 2, 6, '0')) as legal_entity_id", "concat('Entity ', sk div 2) as legal_name",
            "country as country_of_incorporation", "concat(country, '-', lpad(sk div 2, 9, '0')) as registration_id")

    def _vendor_master(self):
        codes = [c for c, *_ in OWNERS]
        return self["vendor_keys"].selectExpr(
            "vendor_id", "concat('V', lpad(sk, 6, '0')) as display_code",
            "concat('LE-', lpad(sk div 2, 6, '0')) as legal_entity_id", "s_name as vendor_name", "country",
            f"{_pick(VENDOR_TYPES, 'sk % 5')} as vendor_type",
            f"concat({_pick(codes, 'sk % 6')}, ', ', {_pick(codes, '(sk + 2) % 6')}) as supported_categories",
            "sk % 3 = 0 as preferred_flag", "incoterms as incoterms_default", "payment_terms", "currency",
            "5 + sk % 50 as lead_time_days_typical",
            f"{_money('7000 + sk * 53 % 2900', 5)} as on_time_delivery_rate",
            "40 + sk * 37 % 59 as quality_score", "10 + sk * 29 % 76 as risk_score",
            "if(sk % 5 = 0, null, 40 + sk * 17 % 56) as esg_score",
            "case when sk % 40 = 7 then 'BLOCKED' when sk % 20 = 3 then 'CONDITIONAL' else 'ACTIVE' end as status",
            "concat(country, '00', lpad(sk, 10, '0')) as bank_account",
            "case sk % 13 when 0 then 'RESTRICTED' when 1 then 'PUBLIC' else 'INTERNAL' end as confidentiality_tier",
            "case when sk % 10 in (0, 1) then concat('AL-', sk div 2) end as alias_group")

    def _vendor_category(self):
        return (self["ordered"].select("pk", "sk").join(self["part_keys"].select("pk", "l1", "brand"), "pk")
                .selectExpr("concat('VND-', lpad(sk, 6, '0')) as vendor_id", "concat_ws('-', l1, brand) as category_id").distinct())

    def _vendor_address(self):
        return self["vendor_keys"].selectExpr(
            "vendor_id", "concat('City ', country) as city", "concat('State ', sk % 50) as state_province",
            "lpad(sk % 100000, 5, '0') as postal_code",
            "inline(array(struct('LEGAL' as address_type, concat(sk, ' Main Street') as street, country as country), "
            "struct('SHIPPING' as address_type, concat(sk, ' Dock Road') as street, "
            "if(sk % 6 = 0, 'HK', country) as country)))")

    def _vendor_contact(self):
        return self["vendor_keys"].selectExpr(
            "concat('CT-', lpad(sk, 8, '0')) as contact_id", "vendor_id", "concat('Contact ', sk) as contact_name",
            "concat('contact', sk, '@example.com') as email",
            "concat('+65 ', lpad(sk % 100000000, 8, '0')) as phone", "'SALES' as role")

    # --- sourcing ---------------------------------------------------------

    def _contract_header(self):
        return self["vendor_keys"].filter("sk % 20 <> 3").selectExpr(
            "concat('CTR-', lpad(sk, 6, '0')) as contract_id", "concat('C', sk) as display_code", "vendor_id",
            "date'1995-06-01' as valid_from", "add_months(date'2001-05-31', cast(sk % 12 as int)) as valid_to",
            "if(sk % 2 = 0, 'QUANTITY', 'VALUE') as contract_type",
            "if(sk % 12 >= 1, 'ACTIVE', 'EXPIRED') as status", "currency", "incoterms",
            "case sk % 9 when 0 then 'RESTRICTED' when 1 then 'PUBLIC' else 'INTERNAL' end as confidentiality_tier")

    def _agreements(self):
        pairs = self["ordered"].filter("(pk + sk) % 3 <> 0 and sk % 20 <> 3").select("sk", "pk").distinct()
        return pairs.join(self["part_keys"].select("pk", "standard_c"), "pk").select("sk", "pk", "standard_c")

    def _contract_item(self):
        priced = self["agreements"].selectExpr(
            "*", "concat('MAT-', lpad(pk, 8, '0')) as material_id", "standard_c * (85 + pk % 36) div 100 as agreed_c").selectExpr(
            "*", "agreed_c * (50 + pk % 50) as target_c")
        return priced.selectExpr(
            "concat('CTR-', lpad(sk, 6, '0')) as contract_id", "10 * (pk + 1) as item_number", "material_id",
            f"{_money('agreed_c', 12)} as agreed_price", "'EA' as price_uom",
            "if(sk % 2 = 0, 500 + pk % 4500, null) as max_quantity",
            f"if(sk % 2 = 1, {_money('target_c', 12)}, null) as target_value",
            "if(sk % 2 = 0, pk * 7 % (500 + pk % 4500), null) as consumed_quantity",
            f"if(sk % 2 = 1, {_money('target_c * (pk % 100) div 100', 12)}, null) as consumed_value")

    def _lanes(self):
        lanes = self["ordered"].selectExpr("pk", "sk", "concat('PL0', ck % 5) as plant_id").distinct()
        return lanes.withColumn("preferred_rank", F.row_number().over(W.partitionBy("pk", "plant_id").orderBy("sk")))

    def _source_list(self):
        return self["lanes"].selectExpr(
            "concat('MAT-', lpad(pk, 8, '0')) as material_id", "plant_id",
            "concat('VND-', lpad(sk, 6, '0')) as vendor_id", "preferred_rank",
            "(pk + sk) % 3 <> 0 and sk % 20 <> 3 as contract_covered_flag",
            "if(sk % 20 = 3, 'CONDITIONAL', 'APPROVED') as approval_status",
            "5 + (pk + sk) % 56 as lane_lead_time_days", "concat('VM-', pk, '-', sk) as vendor_material_code",
            "if(pk % 3 = 0, null, 1 + pk % 20) as min_order_qty", "'INTERNAL' as confidentiality_tier",
            "date'1995-01-01' as valid_from", "cast(null as date) as valid_to")

    def _uom_conversion(self):
        return self["part_keys"].filter("pk % 50 = 0").selectExpr(
            "material_id", "'EA' as from_uom", "'BOX' as to_uom", "0.01 as conversion_factor")

    # --- documents ----------------------------------------------------------

    def _requests(self):
        return self.raw("orders").selectExpr(
            "o_orderkey as ok", "concat('PR-', lpad(o_orderkey, 8, '0')) as pr_id",
            "date_sub(cast(o_orderdate as date), 7) as pr_date", "o_custkey as ck", "o_orderpriority",
            "case when o_orderkey % 20 = 9 then 'APPROVED' when o_orderkey % 20 = 18 then 'OPEN' "
            "when o_orderkey % 40 = 38 then 'CANCELLED' else 'CONVERTED' end as status")

    def _pr_header(self):
        return self["requests"].selectExpr(
            "pr_id", "pr_date", "concat('Requester ', ck) as requester_name",
            "if(ck % 2 = 0, 'Production', 'Engineering') as requester_department",
            "concat('CC-PL0', ck % 5, if(ck % 2 = 0, '-PRD', '-ENG')) as cost_center_id",
            "concat('PL0', ck % 5) as plant_id",
            "case o_orderpriority when '1-URGENT' then 'URGENT' when '5-LOW' then 'BLANKET' else 'STANDARD' end as pr_type",
            "status",
            "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' "
            "else 'LOW' end as priority", "cast(null as string) as notes")

    def _requested(self):
        lines = self["moves"].select("ok", "pk", "pr_line", "qty", "requested")
        parts = self["part_keys"].select("pk", "l1", "standard_c")
        owners = self["owners"].select("l1", "grp")
        return lines.join(parts, "pk").join(owners, "l1").join(self["requests"].select("ok", "status"), "ok").select(
            "ok", "pk", "pr_line", "qty", "requested", "standard_c", "status", "grp")

    def _pr_line_item(self):
        return self["requested"].selectExpr(
            "concat('PR-', lpad(ok, 8, '0')) as pr_id", "pr_line as pr_line_number", "concat('MAT-', lpad(pk, 8, '0')) as material_id",
            "qty as quantity", "'EA' as uom", "requested as requested_delivery_date",
            f"if(pk % 17 <> 0, {_money('standard_c', 12)}, null) as estimated_price", "'USD' as currency",
            "case status when 'CONVERTED' then 'PO_CREATED' when 'CANCELLED' then 'CANCELLED' "
            "when 'APPROVED' then 'ASSIGNED' else 'OPEN' end as status", "grp as assigned_purch_group_id")

    def _po_header(self):
        heads = self["moves"].filter("heads_order").select(
            "po_id", "ok", "sk", "od", "vendor_id", "ck", "plant_id", "o_orderpriority", "received", "total_c", "nations",
            F.col("any_covered").alias("covered"))
        return (
            _with_vendor(heads, "incoterms", "payment_terms", "currency").withColumn("maverick_flag", F.expr("not covered and (ok + sk) % 11 = 0"))
            .selectExpr(
                "po_id", "od as po_date", "vendor_id", "if(ck % 2 = 0, 'PO01', 'PO02') as purch_org_id",
                "concat('PG0', sk % 6 + 1) as purch_group_id", "plant_id",
                "if(o_orderpriority = '1-URGENT', 'RUSH', 'STANDARD') as po_type",
                "if(received, 'FULLY_RECEIVED', 'SENT') as status", "incoterms", "payment_terms", "currency",
                f"{_money('total_c')} as total_net_value", "maverick_flag",
                "if(maverick_flag, 'Maverick purchase, non-preferred vendor', null) as notes"))

    def _po_line_item(self):
        return _with_vendor(self["moves"], "currency").selectExpr(
            "po_id", "line as po_line_number", "material_id", "qty as quantity", "'EA' as uom",
            f"{_money('price_c', 12)} as unit_price", f"{_money('qty * price_c')} as net_value",
            "currency as price_currency", "requested as requested_delivery_date",
            "if(received, actual, null) as actual_delivery_date",
            "if(covered, concat('CTR-', lpad(sk, 6, '0')), null) as contract_id",
            "if(covered, 10 * (pk + 1), null) as contract_item_number",
            "if(ok % 10 < 8, pr_id, null) as pr_id", "if(ok % 10 < 8, pr_line, null) as pr_line_number",
            "10 as over_delivery_tolerance", "5 as under_delivery_tolerance",
            "if(received, 'COMPLETE', 'OPEN') as gr_status", "if(invoiced, 'COMPLETE', 'OPEN') as invoice_status")

    def _gr_header(self):
        return self["moves"].filter("received").selectExpr(
            "gr_id", "actual as gr_date", "po_id", "plant_id", "concat(plant_id, '-RAW') as storage_loc_id",
            "concat('Clerk ', ck % 7) as received_by",
            "if((pk + sk) % 24 = 0, 'QUALITY_HOLD', 'POSTED') as status", "cast(null as string) as notes")

    def _gr_line_item(self):
        return self["moves"].filter("received").selectExpr(
            "gr_id", "10 as gr_line_number", "po_id", "line as po_line_number", "material_id",
            f"{_money('received_h', 12)} as quantity_received", "'EA' as uom",
            f"{_money('received_h - rejected_h', 12)} as quantity_accepted",
            f"{_money('rejected_h', 12)} as quantity_rejected",
            f"if(rejected_h > 0, {_pick(REASONS, 'pk % 4')}, null) as rejection_reason",
            "if(pk % 2 = 0, concat('B', pk, '-', ok % 1000), null) as batch_number")

    def _invoice_header(self):
        return self["bills"].selectExpr(
            "concat('INV-', doc, copy) as invoice_id",
            "concat('VIN-', lpad(sk, 6, '0'), '-', if(copy = 'D', concat(substr(lpad(ok, 8, '0'), 1, 7), 'X'), "
            "lpad(ok, 8, '0'))) as vendor_invoice_number",
            "invoice_date", "date_add(invoice_date, cast(ok % 4 as int)) as received_date", "vendor_id", "po_id",
            "currency", f"{_money('gross_c')} as total_gross_amount", f"{_money('tax_c', 12)} as tax_amount",
            f"{_money('net_c')} as total_net_amount",
            "case when price_bad or qty_bad then 'EXCEPTION' when (ok + sk) % 9 <> 0 and ok % 101 <> 0 then 'PAID' "
            "else 'MATCHED' end as status",
            "case when price_bad and qty_bad then 'BOTH_VARIANCE' when price_bad then 'PRICE_VARIANCE' "
            "when qty_bad then 'QUANTITY_VARIANCE' else 'FULL_MATCH' end as match_status",
            "date_add(invoice_date, days) as payment_due_date", "price_bad or qty_bad as payment_block",
            "case when price_bad then 'PRICE_MISMATCH' when qty_bad then 'QTY_MISMATCH' end as block_reason")

    def _invoice_line_item(self):
        return self["billed"].withColumn("copy", F.explode(F.expr("if(ok % 97 = 0, array('', 'D'), array(''))"))).selectExpr(
            "concat('INV-', doc, copy) as invoice_id", "line as invoice_line_number", "po_id",
            "line as po_line_number", "material_id", f"{_money('inv_h', 12)} as quantity_invoiced",
            f"{_money('inv_price_c', 12)} as unit_price_invoiced",
            f"{_money('(inv_price_c * inv_h + 50) div 100')} as net_amount", "gr_id", "10 as gr_line_number",
            f"{_money('inv_price_c - price_c', 12)} as price_variance",
            f"{_money('inv_h - accepted_h', 12)} as quantity_variance")

    def _payment(self):
        return _with_vendor(self["paid"], "country").selectExpr(
            "concat('PAY-', doc, copy) as payment_id", "date_add(invoice_date, wait) as payment_date", "vendor_id",
            "if(ok % 2 = 0, 'BANK_TRANSFER', 'WIRE') as payment_method", "currency",
            f"{_money('net_c - discount_c')} as total_amount",
            "concat(country, '00', lpad(sk, 10, '0')) as bank_account_ref",
            "payment_terms as payment_terms_applied", f"{_money('discount_c', 12)} as early_payment_discount",
            "if(ok % 101 = 0, 'FAILED', 'EXECUTED') as status")

    def _payment_invoice_link(self):
        return self["paid"].selectExpr(
            "concat('PAY-', doc, copy) as payment_id", "concat('INV-', doc, copy) as invoice_id",
            f"{_money('net_c - discount_c')} as amount_applied")


_open: dict[tuple[str, str], PurchasingTables] = {}


def purchasing_tables(spark: SparkSession, source_dir: str) -> PurchasingTables:
    """The tables of ``source_dir``, shared by all queries of one session."""
    key = (spark.sparkContext.applicationId, source_dir)
    if key not in _open:
        _open[key] = PurchasingTables(tune(spark), source_dir)
        dealt_by_size(spark, source_dir)
    return _open[key]
