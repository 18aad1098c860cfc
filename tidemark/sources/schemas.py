"""Typed schemas of the canonical tables.

Fixed values: table, column, type and nullability names that a reader of the tables relies on. A trailing ``!`` marks
a column that must not be null.
"""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    "s": T.StringType(), "ts": T.TimestampType(), "d": T.DoubleType(), "b": T.BooleanType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i64": T.LongType(),
}
COMMON = "dataset_version:s! chain_id:s! platform_id:s!"


def table(spec: str, common: bool = True) -> T.StructType:
    """Schema from ``name:kind`` words."""
    fields = []
    for item in f"{COMMON if common else ''} {spec}".split():
        name, kind = item.rstrip("!").split(":")
        fields.append(T.StructField(name, KINDS[kind], not item.endswith("!")))
    return T.StructType(fields)


SINGLE_CHAIN = {
    "tokens": table("token_id:s! mint:s! symbol:s name:s created_at:ts token_program:s creator:s"),
    "launches": table(
        "token_id:s! mint:s! launch_at:ts observed_at:ts initial_market_cap_sol:d description_length:i64 has_twitter:b has_website:b "
        "has_telegram:b social_count:i8 source_record_type:s!"
    ),
    "lifecycle_events": table(
        "token_id:s! mint:s! event_type:s! event_at:ts minutes_from_launch_observed:d minutes_from_launch_chain:d final_market_cap_sol:d "
        "detection_lag_minutes:d source_record_type:s!"
    ),
    "token_metadata": table(
        "token_id:s! mint:s! metadata_status:s metadata_complete:b creator:s bonding_curve:s associated_bonding_curve:s pool_address:s "
        "token_program:s protocol:s last_trade_at:ts ath_market_cap_usd:d ath_market_cap_at:ts current_market_cap_usd:d total_supply_raw:d"
    ),
    "pool_windows": table(
        "token_id:s! mint:s! graduated_at:ts horizon_days:i16! pool_address:s transaction_proxy_count:i64 active_traders:i64 volume_usd:d "
        "first_trade_at:ts last_trade_at:ts signatures_scanned:i64 transactions_parsed:i64 window_status:s validation_status:s metric_semantics:s!"
    ),
    "decoded_swaps": table(
        "token_id:s! mint:s! graduated_at:ts horizon_days:i16! transaction_hash:s! transaction_index:i64 transaction_type:s block_timestamp:ts "
        "block_number:i64 wallet_address:s pair_address:s exchange_name:s bought_token_address:s bought_amount:d bought_usd_amount:d "
        "sold_token_address:s sold_amount:d sold_usd_amount:d total_value_usd:d source:s"
    ),
    "token_horizons": table(
        "token_id:s! mint:s! graduated_at:ts horizon_days:i16! decoded_trade_count:i64 decoded_buy_count:i64 decoded_sell_count:i64 "
        "decoded_volume_usd:d decoded_active_traders:i64 first_decoded_trade_at:ts last_decoded_trade_at:ts window_status:s swaps_fetched:i64 "
        "pages_fetched:i64 is_complete_window:b! source:s"
    ),
    "coverage_ledger": table(
        "token_id:s! mint:s! graduated_at:ts metadata_available:b! pool_address_available:b! rpc_windows_available:i8! "
        "decoded_windows_available:i8! decoded_swaps_available:b! decoded_windows_complete:i8! coverage_status:s!"
    ),
}

CROSS_CHAIN = {
    "tokens": table("token_id:s! address:s! symbol:s name:s creator:s created_at:ts decimals:i16 total_supply_raw:s source_id:s! source_record_id:s"),
    "launches": table(
        "launch_id:s! token_id:s! launch_at:ts block_number:i64 transaction_hash:s log_index:i64 factory_or_manager:s pool_id:s pool_address:s "
        "paired_token:s protocol_version:s launch_status:s source_id:s! coverage_role:s!"
    ),
    "protocol_config": table(
        "token_id:s! creator:s message_sender:s starting_tick:i64 pool_hook:s pool_hook_label:s locker:s mev_module:s mev_module_label:s "
        "extensions_supply_raw:s protocol_version:s manager_address:s implementation_address:s token_index:i64 request_id:s launch_fee_raw:s "
        "version_status:s! module_status:s! observation_status:s! source_id:s!"
    ),
    "pools": table(
        "token_id:s! pool_id:s! pool_address:s pool_manager:s currency0:s currency1:s fee_hundredths_bip:i64 tick_spacing:i64 hooks:s "
        "sqrt_price_x96:s initial_tick:i64 initialized_at:ts initialization_transaction_hash:s initialization_log_index:i64 mapping_status:s! "
        "initialization_status:s! source_id:s!"
    ),
    "liquidity_initializations": table(
        "liquidity_event_id:s! token_id:s! pool_id:s! event_at:ts block_number:i64 transaction_hash:s log_index:i64 sender:s tick_lower:i64 "
        "tick_upper:i64 liquidity_delta_raw:s amount0_raw:s amount1_raw:s initialization_type:s salt:s observation_status:s! source_id:s!"
    ),
    "lifecycle_events": table(
        "lifecycle_event_id:s! token_id:s! pool_id:s event_type:s! event_at:ts block_number:i64 transaction_hash:s log_index:i64 "
        "observation_status:s! source_id:s!"
    ),
    "token_metadata": table("token_id:s! description:s image_url:s website_url:s twitter_url:s telegram_url:s category:s source_id:s!"),
    "token_state_snapshots": table(
        "token_id:s! observed_at:ts status:s progress_percent:d price_native:d market_cap_native:d market_cap_usd:d volume_24h_native:d "
        "volume_24h_usd:d holder_count:i64 pool_address:s source_id:s! coverage_role:s!"
    ),
    "coverage_ledger": table(
        "token_id:s! launch_available:b! metadata_available:b! state_snapshot_available:b! decoded_swaps_available:b! creator_status:s! "
        "protocol_config_status:s! pool_mapping_status:s! pool_initialization_status:s! liquidity_initialization_status:s! graduation_status:s! "
        "migration_status:s! decoded_swaps_status:s! holder_data_status:s! trading_data_status:s! coverage_status:s! limitation:s"
    ),
}

EVENTS = table(
    "dataset_version:s! event_id:s! event_aliases:s event_type:s! platform_id:s! chain_id:s! rule_family:s! rule_change:s! announcement_at:ts "
    "activation_at:ts anticipation_start_at:ts concurrent_shocks:s comparison_unit_status:s! eligibility_status:s! rejection_reason:s "
    "hypothesis_tags:s! claim_boundary:s! evidence_status:s!", common=False,
)
EVIDENCE = table(
    "dataset_version:s! evidence_id:s! event_id:s! evidence_type:s! evidence_role:s! observed_at:ts block_number:i64 transaction_hash:s "
    "next_block_verification:s! verification_status:s! supports_eligibility:s! source_id:s! source_path:s! source_sha256:s! evidence_detail:s! "
    "claim_boundary:s!", common=False,
)
