from axiomill.cli import main

raise SystemExit(main())
