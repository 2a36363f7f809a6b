"""Tables in the cluster's shared folder, as the whole library writes them."""

from siltstone.sources.shared import Workspace, delete_path, shared_dir

__all__ = ["Workspace", "delete_path", "shared_dir"]
