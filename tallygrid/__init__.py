"""Multi-tenant product-event analytics expressed as Spark DataFrame jobs."""

from tallygrid.session import build_session, configure, new_run_dir, shared_dir

__all__ = ["build_session", "configure", "new_run_dir", "shared_dir"]
