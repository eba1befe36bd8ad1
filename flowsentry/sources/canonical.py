"""Canonical transaction schema, its header aliases and known layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TXN_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("sender_account_id", T.StringType()),
        T.StructField("receiver_account_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("is_mule_pattern", T.IntegerType()),
    ]
)

DEFAULT_TYPE = "TRANSFER"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    aliases: tuple[str, ...]


# Canonical fields and the header names accepted for them.
FIELDS = (
    Field("transaction_id", "string", True, (
        "transaction_id", "txn_id", "transaction_no", "transaction_number", "reference_no", "reference_id",
        "ref_id", "tx_id", "txid", "payment_id", "id", "transfer_id", "uuid", "row_id", "txn_ref", "trans_id")),
    Field("sender_account_id", "string", True, (
        "sender", "sender_id", "sender_account", "sender_account_id", "from_account", "from_account_id",
        "source_account", "source_account_id", "debit_account", "debit_account_id", "origin_account",
        "originator_account", "nameorig", "orig_account", "from_acct", "source_acct", "payer", "payer_account",
        "remitter_account", "sending_account", "account_from")),
    Field("receiver_account_id", "string", True, (
        "receiver", "receiver_id", "receiver_account", "receiver_account_id", "to_account", "to_account_id",
        "destination_account", "destination_account_id", "credit_account", "credit_account_id",
        "beneficiary_account", "namedest", "dest_account", "to_acct", "dest_acct", "payee", "payee_account",
        "beneficiary", "receiving_account", "account_to")),
    Field("amount", "float", True, (
        "amount", "txn_amount", "transaction_amount", "transaction_value", "value", "transfer_amount",
        "debit_amount", "credit_amount", "amt", "txn_amt", "volume", "sum", "payment_amount", "val")),
    Field("timestamp", "datetime", True, (
        "timestamp", "datetime", "date_time", "transaction_time", "txn_time", "created_at", "event_time",
        "transaction_date", "date", "time", "step", "trans_date", "txn_datetime", "ts", "dt")),
    Field("transaction_type", "string", False, (
        "transaction_type", "txn_type", "type", "mode", "channel", "payment_mode", "payment_type",
        "transfer_type", "method")),
    Field("is_mule_pattern", "integer", False, (
        "is_mule_pattern", "is_mule", "isfraud", "is_fraud", "fraud_label", "target", "label", "mule_label",
        "is_suspicious", "flag")),
    Field("old_balance_sender", "float", False, (
        "oldbalanceorg", "old_balance_sender", "sender_old_balance", "orig_balance_before")),
    Field("new_balance_sender", "float", False, (
        "newbalanceorig", "new_balance_sender", "sender_new_balance", "orig_balance_after")),
    Field("old_balance_receiver", "float", False, (
        "oldbalancedest", "old_balance_receiver", "receiver_old_balance", "dest_balance_before")),
    Field("new_balance_receiver", "float", False, (
        "newbalancedest", "new_balance_receiver", "receiver_new_balance", "dest_balance_after")),
    Field("currency", "string", False, ("currency", "curr", "ccy", "currency_code")),
    Field("device_id", "string", False, ("device_id", "device", "mac_address", "fingerprint")),
    Field("ip_address", "string", False, ("ip_address", "ip", "client_ip", "user_ip")),
    Field("location", "string", False, ("location", "country", "city", "geo", "country_code")),
)

MANDATORY = ("sender_account_id", "receiver_account_id", "amount", "timestamp")


@dataclass(frozen=True)
class Layout:
    """Source column -> canonical column, and how time is written."""

    name: str
    columns: dict[str, str]
    time_mode: str  # 'datetime' or 'step_hours'


# The known header layouts.
LAYOUTS = (
    Layout("canonical", {
        "transaction_id": "transaction_id", "sender_account_id": "sender_account_id",
        "receiver_account_id": "receiver_account_id", "amount": "amount", "timestamp": "timestamp",
        "transaction_type": "transaction_type", "is_mule_pattern": "is_mule_pattern"}, "datetime"),
    Layout("paysim", {
        "nameOrig": "sender_account_id", "nameDest": "receiver_account_id", "amount": "amount",
        "step": "timestamp", "type": "transaction_type", "isFraud": "is_mule_pattern"}, "step_hours"),
    Layout("alt_standard", {
        "transaction_id": "transaction_id", "sender_id": "sender_account_id", "receiver_id": "receiver_account_id",
        "amount": "amount", "timestamp": "timestamp", "transaction_type": "transaction_type",
        "fraud_label": "is_mule_pattern"}, "datetime"),
)


def detect_layout(columns: list[str]) -> Layout | None:
    """The first known layout whose mandatory source columns are all present."""
    present = set(columns)
    for layout in LAYOUTS:
        needed = {src for src, dst in layout.columns.items() if dst in MANDATORY}
        if needed <= present:
            return layout
    return None
