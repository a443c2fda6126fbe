"""Names and value sets that tables share (fixed values)."""

from __future__ import annotations

NO_KNOWN, KNOWN, CRITICAL, UNDECIDED = "sem_cve_conhecida", "cve_conhecida", "cve_critica", "indeterminado"
CLASSES = [NO_KNOWN, KNOWN, CRITICAL]
NOT_FOUND = "nao_encontrado"
SINGLE, CONSERVATIVE = "alias_unico", "agregacao_conservadora"

OTHER, MISSING = "outro", "ausente"
REASONS = ["falha_extracao", "terceiros", "indeterminado"]
STATES = {
    "meta_binwalk_status": (["ok"], ["erro"], ["timeout", "nao_executado"]),
    "meta_unpack_status": (["ok", "sem_filesystem", "criptografado", "limite_tamanho", "limite_arquivos"], ["falha"], ["limite_tempo", "nao_executado"]),
    "meta_fs_status": (["ok", "nao_executado"], ["erro"], []),
}
FORBIDDEN_PREFIXES = ["meta_", "doc2vec_", "cve_count_"]
FORBIDDEN = "vendor model version version_source cve_total cvss_max label_strategy alias_count".split()
DEMOTED = (
    "count_hardcoded_passwords count_credential_pairs count_api_tokens count_non_public_ips count_public_ips has_debug_account "
    "n_crypto_signatures has_encrypted_sections"
).split()
ONE_HOT_SOURCES = ["fs_type", "compression_type"]
