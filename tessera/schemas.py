"""Schemas of the engine's tables."""

FILES = "path string, content binary, modificationTime timestamp, length bigint, project_id string"
CHUNKS = "chunk_id string, project_id string, project_name string, file_path string, language string, start_line int, end_line int, function_name string, class_name string, layer_type string, token_count int, content string, file_hash string, metadata map<string,string>"
SECRETS = "chunk_id string, secret_type string, pattern_name string, confidence double, line_number int, start_position int, end_position int, content string, context string"
VECTORS = "chunk_id string, project_id string, embedding array<float>, model string, dims int"
STATE = "project_id string, file_path string, file_hash string"
CHANGES = "file_path string, change_type string, old_path string, file_hash string"
REQUESTS = "ts timestamp, endpoint string, duration_ms double, status_code int"
METRICS = "ts timestamp, name string, type string, value double, labels map<string,string>"
ERRORS = "ts timestamp, category string, severity string, error_type string, message string"
ALERTS = "rule string, alert_type string, severity string, triggered_at timestamp, resolved_at timestamp"
PROJECTS = "project_id string, name string, description string, repository_path string, primary_language string, status string, created_at timestamp, updated_at timestamp, total_chunks bigint, total_files bigint, last_processed_commit string"
UPDATES = "request_id string, project_id string, status string, processing_time double, files_processed int, chunks_added int, chunks_updated int, chunks_deleted int, created_at timestamp"
#: What a language parser returns for a file.
PARSED = "file_path string, language string, start_line int, end_line int, function_name string, class_name string, layer_type string, token_count int, content string, metadata map<string,string>"

#: Closed domains (fixed values).
LANGUAGES = ("java", "kotlin", "html", "xml", "yaml", "properties", "python", "unknown")
LAYERS = ("Controller", "Service", "Repository", "Entity", "Config", "Util", "Test", "Template", "View", "Serializer", "Form", "Admin", "Middleware", "Signal", "Task", "Command", "Migration", "Router", "Schema", "Unknown")
SENSITIVITY = ("LOW", "MEDIUM", "HIGH")
