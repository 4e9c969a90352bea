"""Declared tables of the three splits: columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SPLITS = ("train", "score", "serve")
FOLDERS = {"training": "train", "serving": "serve", "scoring": "score"}

_CUSTOMER = (
    "c_customer_sk int, c_customer_id string, c_current_addr_sk int, c_first_name string, c_last_name string, "
    "c_preferred_cust_flag string, c_birth_day int, c_birth_month int, c_birth_year int, c_birth_country string, "
    "c_login string, c_email_address string"
)
_SMART = ", ".join(f"smart_{n}_raw double" for n in (5, 10, 184, 187, 188, 197, 198))
_DEVICE_DAY = "date date, serial_number string, model string, failure int"
_PAYMENT = "transactionid bigint, amount double, iban string, senderid bigint, receiverid string, time timestamp_ntz"


@dataclass(frozen=True)
class Table:
    """``train_only`` columns are labels: a separate table in ``score``, absent in ``serve``."""

    columns: str
    key: tuple[str, ...] = ()
    train_only: str = ""
    except_train: str = ""
    references: tuple[tuple[str, str, str], ...] = ()  # (column, table, column)
    not_null: tuple[str, ...] = ()
    splits: tuple[str, ...] = SPLITS
    serial: str = ""  # column numbered in load order
    file: str = ""
    dedup: bool = field(default=False)  # keep the first row per key when loading

    def schema(self, split: str) -> T.StructType:
        extra = self.train_only if split == "train" else self.except_train
        serial = f"{self.serial} bigint" if self.serial else ""
        return T.StructType.fromDDL(", ".join(part for part in (serial, self.columns, extra) if part))

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.key, *self.not_null)))


_SCORE = ("score",)
_LATER = ("score", "serve")
_TO_ORDER = "order", "o_order_id"
_TO_PRODUCT = "product", "p_product_id"

TABLES: dict[str, Table] = {
    "conversation_audio": Table("wav_filename string", ("wav_filename",), "transcript string"),
    "conversation_audio_labels": Table("wav_filename string, transcript string", ("wav_filename",), splits=_SCORE),
    "customer_images_meta": Table("identity_serving string, sample int, img_filename string", ("img_filename",), dedup=True),
    "customer_images_meta_labels": Table(
        "identity string, identity_serving string, sample int, img_filename string",
        ("img_filename",), splits=_SCORE, dedup=True,
    ),
    "customer": Table(_CUSTOMER, ("c_customer_sk",), "c_cluster_id int", dedup=True),
    "customer_labels": Table("c_customer_sk int, c_cluster_id int", ("c_customer_sk",), splits=_SCORE, dedup=True),
    "failures": Table(f"{_DEVICE_DAY}, {_SMART}", ("id",), serial="id"),
    "failures_labels": Table(_DEVICE_DAY, ("id",), splits=_SCORE, serial="id"),
    "financial_account": Table("fa_customer_sk bigint, transaction_limit decimal(8,2)", ("fa_customer_sk",), dedup=True),
    "financial_transactions": Table(_PAYMENT, ("transactionid",), "isfraud boolean", dedup=True),
    "financial_transactions_labels": Table(
        "transactionid bigint, isfraud boolean", ("transactionid",), splits=_SCORE, dedup=True
    ),
    "product": Table("p_product_id int, name string, department string", ("p_product_id",), dedup=True),
    "order": Table(
        "o_order_id int, o_customer_sk int, weekday string, date date, store int",
        ("o_order_id",), "trip_type int",
        references=(("o_customer_sk", "customer", "c_customer_sk"),), dedup=True,
    ),
    "order_labels": Table("o_order_id int, trip_type int", ("o_order_id",), splits=_SCORE),
    "lineitem": Table(
        "li_order_id int, li_product_id int, quantity int, price decimal(8,2)",
        not_null=("li_order_id", "li_product_id"),
        references=(("li_order_id", *_TO_ORDER), ("li_product_id", *_TO_PRODUCT)),
    ),
    "marketplace": Table("id int, description string", ("id",), "price decimal(8,2)"),
    "marketplace_labels": Table("id int, price decimal(8,2)", ("id",), splits=_SCORE),
    "order_returns": Table(
        "or_order_id int, or_product_id int, or_return_quantity int",
        references=(("or_order_id", *_TO_ORDER), ("or_product_id", *_TO_PRODUCT)),
    ),
    "productrating": Table("userid int, productid int", ("userid", "productid"), "rating int", dedup=True),
    "productrating_labels": Table(
        "userid int, productid int, rating int", ("userid", "productid"), splits=_SCORE, dedup=True
    ),
    "review": Table("id int, text string", ("id",), "spam int", file="review.psv", dedup=True),
    "review_labels": Table("id int, spam int", ("id",), splits=_SCORE, file="review_labels.psv"),
    "store_dept": Table("store int, department string", ("store", "department"), except_train="periods int"),
    "store_dept_labels": Table(
        "store int, department string, date date, weekly_sales double", ("store", "department", "date"), splits=_SCORE
    ),
    "sales": Table("store int, spread double", ("store",), splits=_LATER),
}


def file_name(table: str) -> str:
    return TABLES[table].file or f"{table}.csv"
