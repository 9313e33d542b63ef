"""The messages table and the constants of identity keys."""

from __future__ import annotations

KEY = "struct<kind:string,value:string>"
END = "struct<ip:string,port:int,host:string,role:string,lane:string>"
MESSAGES = (
    f"capture_id string, frame long, seq int, ts double, event_time timestamp, protocol string, label string, src {END}, dst {END}, "
    f"keys array<{KEY}>, releases array<{KEY}>, quotes array<struct<kind:string,value:string,looks:string>>, "
    "cause struct<table:string,value:int>, is_failure boolean, detail map<string,string>"
)
#: Columns that identify a message, and its total orders.
ROW = ("capture_id", "frame", "seq")
IN_TIME = ("ts", "frame", "seq")
BY_FRAME = ("frame", "ts", "seq")

# The kinds of identity keys by what they point at, the order in
# which a subscriber is named, and the kinds whose values are used again.
SUBSCRIBER = ("supi", "impi", "impu", "msisdn", "ran_ue_ngap_id", "amf_ue_ngap_id", "fiveg_s_tmsi", "s_tmsi", "enb_ue_s1ap_id", "mme_ue_s1ap_id")
SESSION = ("pfcp_seid", "sm_context_ref", "h248_context", "media_endpoint", "gtp_teid", "gtp_teid_c", "sip_call_id", "diameter_session_id")
EXCHANGE = ("sbi_stream", "h248_transaction", "gtpv2_transaction")
TITLE_ORDER = ("supi", "impu", "msisdn", "impi", "fiveg_s_tmsi", "s_tmsi", "amf_ue_ngap_id", "ran_ue_ngap_id", "mme_ue_s1ap_id", "enb_ue_s1ap_id")
REUSABLE = ("ran_ue_ngap_id", "amf_ue_ngap_id", "pfcp_seid", "gtp_teid", "sm_context_ref", "sbi_stream", "h248_context", "media_endpoint", "gtpv2_transaction")
SOLITARY = ("gtpv2_transaction",)
