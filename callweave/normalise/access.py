"""Access side: NGAP, S1AP, SGsAP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.normalise.core import blocks, cause, details, has, key, messages, named, number, scoped, text, texts, tunnels

# NGAP procedure codes (3GPP TS 38.413).
NGAP = {
    0: "AMFConfigurationUpdate", 1: "AMFStatusIndication", 2: "CellTrafficTrace", 3: "DeactivateTrace", 4: "DownlinkNASTransport", 5: "DownlinkNonUEAssociatedNRPPaTransport", 6: "DownlinkRANConfigurationTransfer",
    7: "DownlinkRANStatusTransfer", 8: "DownlinkUEAssociatedNRPPaTransport", 9: "ErrorIndication", 10: "HandoverCancel", 11: "HandoverNotification", 12: "HandoverPreparation", 13: "HandoverResourceAllocation",
    14: "InitialContextSetup", 15: "InitialUEMessage", 16: "LocationReportingControl", 17: "LocationReportingFailureIndication", 18: "LocationReport", 19: "NASNonDeliveryIndication", 20: "NGReset", 21: "NGSetup",
    22: "OverloadStart", 23: "OverloadStop", 24: "Paging", 25: "PathSwitchRequest", 26: "PDUSessionResourceModify", 27: "PDUSessionResourceModifyIndication", 28: "PDUSessionResourceRelease",
    29: "PDUSessionResourceSetup", 30: "PDUSessionResourceNotify", 31: "PrivateMessage", 32: "PWSCancel", 33: "PWSFailureIndication", 34: "PWSRestartIndication", 35: "RANConfigurationUpdate", 36: "RerouteNASRequest",
    37: "RRCInactiveTransitionReport", 38: "TraceFailureIndication", 39: "TraceStart", 40: "UEContextModification", 41: "UEContextRelease", 42: "UEContextReleaseRequest", 43: "UERadioCapabilityCheck",
    44: "UERadioCapabilityInfoIndication", 45: "UETNLABindingRelease", 46: "UplinkNASTransport",
    47: "UplinkNonUEAssociatedNRPPaTransport", 48: "UplinkRANConfigurationTransfer", 49: "UplinkRANStatusTransfer", 50: "UplinkUEAssociatedNRPPaTransport", 51: "WriteReplaceWarning",
    52: "SecondaryRATDataUsageReport", 53: "UplinkRIMInformationTransfer", 54: "DownlinkRIMInformationTransfer", 55: "RetrieveUEInformation", 56: "UEInformationTransfer",
    57: "RANCPRelocationIndication", 58: "UEContextResume", 59: "UEContextSuspend", 60: "UERadioCapabilityIDMapping", 61: "HandoverSuccess", 62: "UplinkRANEarlyStatusTransfer",
    63: "DownlinkRANEarlyStatusTransfer", 64: "AMFCPRelocationIndication", 65: "ConnectionEstablishmentIndication",
}
# S1AP procedure codes (3GPP TS 36.413), and messages whose name isn't procedure plus outcome.
S1AP = {
    0: "HandoverPreparation", 1: "HandoverResourceAllocation", 2: "HandoverNotification", 3: "PathSwitchRequest", 4: "HandoverCancel", 5: "E-RABSetup", 6: "E-RABModify", 7: "E-RABRelease",
    8: "E-RABReleaseIndication", 9: "InitialContextSetup", 10: "Paging", 11: "downlinkNASTransport", 12: "initialUEMessage", 13: "uplinkNASTransport", 14: "Reset", 15: "ErrorIndication",
    16: "NASNonDeliveryIndication", 17: "S1Setup", 18: "UEContextReleaseRequest", 19: "DownlinkS1cdma2000tunnelling", 20: "UplinkS1cdma2000tunnelling", 21: "UEContextModification",
    22: "UECapabilityInfoIndication", 23: "UEContextRelease", 24: "eNBStatusTransfer", 25: "MMEStatusTransfer", 26: "DeactivateTrace", 27: "TraceStart", 28: "TraceFailureIndication",
    29: "ENBConfigurationUpdate", 30: "MMEConfigurationUpdate", 31: "LocationReportingControl", 32: "LocationReportingFailureIndication", 33: "LocationReport", 34: "OverloadStart",
    35: "OverloadStop", 36: "WriteReplaceWarning", 37: "eNBDirectInformationTransfer", 38: "MMEDirectInformationTransfer", 39: "PrivateMessage", 40: "eNBConfigurationTransfer",
    41: "MMEConfigurationTransfer", 42: "CellTrafficTrace", 43: "Kill", 44: "downlinkUEAssociatedLPPaTransport", 45: "uplinkUEAssociatedLPPaTransport", 46: "downlinkNonUEAssociatedLPPaTransport",
    47: "uplinkNonUEAssociatedLPPaTransport", 48: "UERadioCapabilityMatch", 49: "PWSRestartIndication", 50: "E-RABModificationIndication", 51: "PWSFailureIndication", 52: "RerouteNASRequest",
    53: "UEContextModificationIndication", 54: "ConnectionEstablishmentIndication", 55: "UEContextSuspend", 56: "UEContextResume", 57: "NASDeliveryIndication", 58: "RetrieveUEInformation",
    59: "UEInformationTransfer", 60: "eNBCPRelocationIndication", 61: "MMECPRelocationIndication", 62: "SecondaryRATDataUsageReport", 63: "UERadioCapabilityIDMapping", 64: "HandoverSuccess",
    65: "eNBEarlyStatusTransfer", 66: "MMEEarlyStatusTransfer",
}
S1AP_NAMES = {(23, ""): "UEContextReleaseCommand", (23, "Response"): "UEContextReleaseComplete", (9, ""): "InitialContextSetup"}
# SGsAP message types (3GPP TS 29.118).
SGSAP = {
    1: "SGsAP-PAGING-REQUEST", 2: "SGsAP-PAGING-REJECT", 6: "SGsAP-SERVICE-REQUEST", 7: "SGsAP-DOWNLINK-UNITDATA", 8: "SGsAP-UPLINK-UNITDATA", 9: "SGsAP-LOCATION-UPDATE-REQUEST", 10: "SGsAP-LOCATION-UPDATE-ACCEPT",
    11: "SGsAP-LOCATION-UPDATE-REJECT", 12: "SGsAP-TMSI-REALLOCATION-COMPLETE", 13: "SGsAP-ALERT-REQUEST", 14: "SGsAP-ALERT-ACK", 15: "SGsAP-ALERT-REJECT", 16: "SGsAP-UE-ACTIVITY-INDICATION", 17: "SGsAP-EPS-DETACH-INDICATION",
    18: "SGsAP-EPS-DETACH-ACK", 19: "SGsAP-IMSI-DETACH-INDICATION", 20: "SGsAP-IMSI-DETACH-ACK", 21: "SGsAP-RESET-INDICATION", 22: "SGsAP-RESET-ACK", 23: "SGsAP-SERVICE-ABORT-REQUEST", 24: "SGsAP-MO-CSFB-INDICATION",
    26: "SGsAP-MM-INFORMATION-REQUEST", 27: "SGsAP-RELEASE-REQUEST", 29: "SGsAP-STATUS", 31: "SGsAP-UE-UNREACHABLE",
}
SGS_FROM_MME = (2, 6, 8, 9, 12, 14, 15, 16, 17, 19, 24, 31)
SGS_FROM_VLR = (1, 7, 10, 11, 13, 18, 20, 23, 26, 27)
GROUPS = ("radioNetwork", "transport", "nas", "protocol", "misc")


def _outcome(p: str) -> Column:
    return F.when(has(f"{p}_{p}_successfulOutcome_element"), "Response").when(has(f"{p}_{p}_unsuccessfulOutcome_element"), "Failure").otherwise("")


def _cause(p: str) -> Column:
    return F.coalesce(*(cause(f"{p}_{g}", number(f"{p}_{p}_{g}")) for g in GROUPS))


def _releases(keys: str, kinds: tuple[str, ...], when: Column) -> Column:
    return F.when(when, F.filter(keys, lambda k: k["kind"].isin(*kinds)))


def _tmsi(high: Column, middle: Column | None, low: Column) -> Column:
    parts = [high.cast("string")] + ([middle.cast("string")] if middle is not None else []) + [F.lower(F.lpad(F.hex(low), 8, "0"))]
    whole = high.isNotNull() & low.isNotNull() & (F.lit(True) if middle is None else middle.isNotNull())
    return F.when(whole, F.concat_ws("-", *parts))


def ngap_rows(frames: DataFrame) -> DataFrame:
    """NGAP blocks with their code, outcome and keys; carriers of NAS."""
    rows = blocks(frames, "ngap").withColumns({"code": number("ngap_ngap_procedureCode"), "outcome": _outcome("ngap")}).where("code is not null")
    tmsi = _tmsi(number("ngap_ngap_aMFSetID"), number("ngap_ngap_aMFPointer"), number("ngap_ngap_fiveG_TMSI"))
    keys = F.concat(F.array(scoped("ran_ue_ngap_id", number("ngap_ngap_RAN_UE_NGAP_ID")), scoped("amf_ue_ngap_id", number("ngap_ngap_AMF_UE_NGAP_ID")), scoped("fiveg_s_tmsi", tmsi)), tunnels("gtp_teid", texts("ngap_ngap_gTP_TEID"), texts("ngap_ngap_TransportLayerAddressIPv4")))
    return rows.withColumn("__keys", F.array_compact(keys))


def ngap(frames: DataFrame) -> DataFrame:
    rows = ngap_rows(frames)
    code, outcome = F.col("code"), F.col("outcome")
    initiator = F.when((code == 42) & (outcome == ""), "ran").when((code == 41) & (outcome == ""), "core")
    detail = details(rrc_establishment_cause=text("ngap_ngap_RRCEstablishmentCause"), handover_type=text("ngap_ngap_HandoverType"), tac=text("ngap_ngap_tAC"), cell_id=text("ngap_ngap_NRCellIdentity"), release_initiator=initiator, pdu_session_id=text("ngap_ngap_pDUSessionID"), gtp_teid=text("ngap_ngap_gTP_TEID"), gtp_address=text("ngap_ngap_TransportLayerAddressIPv4"), sst=text("ngap_ngap_sST"), qfi=text("ngap_ngap_qosFlowIdentifier"))
    return messages(rows, "ngap", F.concat(named(code, NGAP, "ProcedureCode-"), outcome), F.col("__keys"), outcome == "Failure", detail, _releases("__keys", ("ran_ue_ngap_id", "amf_ue_ngap_id"), (code == 41) & (outcome == "Response")), _cause("ngap"))


def s1ap_rows(frames: DataFrame) -> DataFrame:
    """S1AP blocks with their code, outcome and keys; carriers of NAS."""
    rows = blocks(frames, "s1ap").withColumns({"code": number("s1ap_s1ap_procedureCode"), "outcome": _outcome("s1ap")}).where("code is not null")
    s_tmsi = key("s_tmsi", _tmsi(number("s1ap_s1ap_mMEC"), None, number("s1ap_s1ap_m_TMSI")))
    keys = F.concat(F.array(scoped("enb_ue_s1ap_id", number("s1ap_s1ap_ENB_UE_S1AP_ID")), scoped("mme_ue_s1ap_id", number("s1ap_s1ap_MME_UE_S1AP_ID")), s_tmsi), tunnels("gtp_teid", texts("s1ap_s1ap_gTP_TEID"), texts("s1ap_s1ap_transportLayerAddressIPv4")))
    return rows.withColumn("__keys", F.array_compact(keys))


def s1ap(frames: DataFrame) -> DataFrame:
    rows = s1ap_rows(frames)
    code, outcome = F.col("code"), F.col("outcome")
    label = F.coalesce(*(F.when((code == c) & (outcome == o), n) for (c, o), n in S1AP_NAMES.items()), F.concat(named(code, S1AP, "ProcedureCode-"), outcome))
    initiator = F.when((code == 18) & (outcome == ""), "ran").when((code == 23) & (outcome == ""), "core")
    detail = details(procedure_code=code, outcome=F.nullif(outcome, F.lit("")), rrc_establishment_cause=text("s1ap_s1ap_RRC_Establishment_Cause"), handover_type=text("s1ap_s1ap_HandoverType"), tac=text("s1ap_s1ap_tAC"), cell_id=text("s1ap_s1ap_CellIdentity"), release_initiator=initiator)
    return messages(rows, "s1ap", label, F.col("__keys"), outcome == "Failure", detail, _releases("__keys", ("enb_ue_s1ap_id", "mme_ue_s1ap_id"), (code == 23) & (outcome == "Response")), _cause("s1ap"))


def sgsap(frames: DataFrame) -> DataFrame:
    rows = blocks(frames, "sgsap").withColumn("code", number("sgsap_sgsap_msg_type")).where("code is not null")
    label = named(F.col("code"), SGSAP, "SGsAP message type ")
    side = lambda a, b: F.when(F.col("code").isin(*a), "MME").when(F.col("code").isin(*b), "VLR")
    return messages(rows, "sgsap", label, F.array(key("supi", text("e212_e212_imsi"))), label.endswith("REJECT"), details(), src_role=side(SGS_FROM_MME, SGS_FROM_VLR), dst_role=side(SGS_FROM_VLR, SGS_FROM_MME))
